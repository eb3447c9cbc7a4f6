"""Document fingerprints: the threshold-scaled sketch (7).

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the text's
length.  So sketches of very unequal texts compare, and the sketch of a union is the union of
sketches.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import public_id, texts
from lodecat.operators.order import global_positions


def sketch(text: Column, words: int = 5, fraction: float = 0.25) -> Column:
    """``kept``: the sorted distinct shingle hashes below ``fraction`` of the range; ``least``: the
    smallest hash of all.

    Words are runs without ASCII white space.  Each word is hashed once; a shingle's hash is of its
    words' hashes.  A text of fewer words is one shingle; a text without words has none, and its
    ``least`` is null.  Estimates are made from ``kept`` alone; where it is empty ``least`` names the
    text in its printed fingerprint, so that a text with words is never without one.
    """
    own = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    hashed = F.transform(own, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - words),
                           lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    last = -(1 << 63) + int(fraction * (1 << 64)) - 1
    # let: each step is computed once, by passing it through a one-element array
    step = F.get(F.transform(F.array(hashed), shingles), 0)
    return F.get(F.transform(F.array(step), lambda s: F.struct(
        F.array_sort(F.array_distinct(F.filter(s, lambda x: x <= last))).alias("kept"), F.array_min(s).alias("least"))), 0)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness by two sketches; of two texts without words 1.  Null, no estimate, where
    there are words but neither sketch keeps a hash."""
    a_kept, b_kept = a.getField("kept"), b.getField("kept")
    common = F.size(F.array_intersect(a_kept, b_kept))
    union = F.size(a_kept) + F.size(b_kept) - common
    empty = a.getField("least").isNull() & b.getField("least").isNull()
    return F.when(empty, F.lit(1.0)).when(union > 0, common / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b holds, for texts of very unequal length; 1 if a has none.
    Null, no estimate, if a has shingles but its sketch keeps none."""
    kept = a.getField("kept")
    return F.when(a.getField("least").isNull(), F.lit(1.0)).when(F.size(kept) > 0, F.size(F.array_intersect(kept, b.getField("kept"))) / F.size(kept))


def merged(sketches: Column) -> Column:
    """An aggregate: the sketch of all texts of a group together (their shingles' union)."""
    return F.struct(F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches.getField("kept"))))).alias("kept"),
                    F.min(sketches.getField("least")).alias("least"))


def fingerprint(s: Column) -> Column:
    """The hashes that stand for a text: those kept, else the least of all, if there is one."""
    kept, least = s.getField("kept"), s.getField("least")
    return F.when((F.size(kept) > 0) | least.isNull(), kept).otherwise(F.array(least))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints: the estimate, or where there is none whether they are equal."""
    return F.coalesce(likeness(a, b), a.getField("least").eqNullSafe(b.getField("least")).cast("double"))


def printed(s: Column) -> Column:
    """The fingerprint as text: 16 hex digits a hash, in order."""
    return F.concat_ws("", F.transform(fingerprint(s), lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def next_ids(ids: DataFrame) -> DataFrame:
    """Each row of unique ``doc_id`` with ``next_id``, by range partitions; the first follows the last."""
    placed = global_positions(ids, [F.col("doc_id")], "_at")
    n = placed.agg(F.max("_at")).first()[0] or 0
    after = placed.select(F.when(F.col("_at") == 1, n).otherwise(F.col("_at") - 1).alias("_at"),
                          F.col("doc_id").alias("next_id"))
    return placed.join(after, "_at").drop("_at")


def compare_edits(docs: DataFrame, words: int = 5, fraction: float = 0.25, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and two likenesses.

    The edited text's last quarter is replaced by as many first characters of the next document.
    Only ids and lengths are put in order; a document sends its neighbour a quarter of that one's
    length and its sketch.  Null texts are empty; equal texts have equal fingerprints; a null id
    comes first and stays null.  Rows that share an id each give a row; as the next document the
    one with the least beginning stands for them.  An empty table gives no rows.
    """
    own = texts(docs, id_col, text_col)
    lengths = own.groupBy("doc_id").agg(F.max(F.expr("char_length(text) div 4")).cast("int").alias("quarter"))
    pairs = next_ids(lengths).select(F.col("doc_id").alias("before_id"), "next_id", "quarter")
    sent = own.join(pairs, own.doc_id == pairs.next_id).select(
        F.col("before_id").alias("doc_id"), F.expr("left(text, quarter)").alias("piece"),
        sketch(F.col("text"), words, fraction).alias("sketch"))
    first = sent.groupBy("doc_id").agg(F.min(F.struct("piece", "sketch")).alias("next"))
    edited = own.join(first, "doc_id").withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.expr("concat(left(text, cast(n_chars - n_chars div 4 as int)), left(next.piece, cast(n_chars div 4 as int)))"))
    done = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                         F.col("next.sketch").alias("next_sketch"),
                         sketch(F.col("text"), words, fraction).alias("own"),
                         sketch(F.col("edited"), words, fraction).alias("changed"))
    return done.select(public_id(), "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"),
                       printed(F.col("changed")).alias("edited_fingerprint"),
                       fingerprint_likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                       fingerprint_likeness(F.col("own"), F.col("next_sketch")).alias("near_next"))
