"""Matching texts against vocabularies of any size.

At every place of a text the strings, or runs of words, of the lengths that terms have are looked up as a
whole in a bit set that grows with the terms, behind a first look at how terms start.  What may be a term goes on to a
join, without its surroundings; so neither the texts nor their word sequences are shuffled.  Terms are stored,
since they are read several times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecat.functions.text import blank, squash
from lodecat.session import cut_lineage

#: Bits of the set that turns places away: 16384 longs, whatever the vocabulary.
BITS = 1 << 20
#: Bits of a set for each term, and bits of the largest set, which is sent to every task (some 50 MB).
PER_TERM, MOST_BITS = 8, 1 << 27
#: Letters of a term's head; shorter terms are their own.
HEAD = 8
#: Word boundaries, where text falls into runs of word signs and of others.
RUNS = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"


def _words(units: DataFrame, unit: str, size: int) -> DataFrame:
    at = F.pmod(F.xxhash64(unit), F.lit(size))
    return units.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def may_hold(units: DataFrame, unit: str) -> Callable[[Column], Column]:
    """A test that is true for every unit of the table, and for few others.

    The driver reads at most ``BITS / 64`` numbers.
    """
    held = [0] * (BITS // 64)
    for r in _words(units, unit, BITS).collect():
        held[r["word"]] = r["bits"]
    bits = F.from_json(F.lit(str(held)), "array<bigint>")

    def test(value: Column) -> Column:
        place = F.pmod(F.xxhash64(value), F.lit(BITS))
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        return F.getbit(word, place.bitwiseAND(63).cast("int")) == 1
    return test


def keep_known(rows: DataFrame, column: str, units: DataFrame, unit: str) -> DataFrame:
    """The rows whose ``column`` is a unit of the table, and few others.

    The set grows with the table, so that it turns away as many of any vocabulary: up to ``BITS`` it is a
    part of the test, above it is joined as a table of words, which is broadcast.
    """
    size = min(1 << (PER_TERM * units.count()).bit_length(), MOST_BITS)
    if size <= BITS:
        return rows.filter(F.col(column).isNotNull() & may_hold(units, unit)(F.col(column)))
    words = _words(units, unit, size).select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    placed = rows.filter(F.col(column).isNotNull()).withColumn("_bit", F.pmod(F.xxhash64(column), F.lit(size)))
    held = placed.join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_word"))
    return held.filter(F.getbit("_bits", F.col("_bit").bitwiseAND(63).cast("int")) == 1).select(*rows.columns)


def unit_places(df: DataFrame, key: str, units: Column, terms: DataFrame, joint: str) -> DataFrame:
    """(key, term, place, width): runs of the text's units that may be terms; none that is one is left out.

    ``terms`` has term and its units as an array, and is read some times; ``joint`` stands between units in a
    term.  Places count from 0.  At every place the runs of the widths that terms have are looked up as a whole, so only a run, and not its
    surroundings, goes on to a join.
    """
    listed = terms.select("term", F.size("units").alias("width"), F.get("units", F.lit(0)).alias("first"))
    widths = sorted(r[0] for r in listed.select("width").distinct().collect())  # a few numbers
    if not widths:
        return df.select(key).limit(0).withColumns({"term": F.lit(""), "place": F.lit(0), "width": F.lit(0)})
    runs = df.select(key, units.alias("_units")).select(key, "_units", F.posexplode_outer("_units").alias("place", "unit"))
    if widths != [1]:
        runs = keep_known(runs, "unit", listed.select("first").distinct(), "first")
    at = lambda w: F.col("unit") if w == 1 else F.when(
        F.col("place") + w <= F.size("_units"), F.array_join(F.slice("_units", F.col("place") + 1, F.lit(w)), joint))
    each = runs.select(key, "place", F.explode(F.array(*[F.struct(at(w).alias("term"), F.lit(w).alias("width")) for w in widths])).alias("r"))
    return keep_known(each.select(key, "r.term", "place", "r.width"), "term", listed, "term")


def unit_hits(df: DataFrame, key: str, units: Column, terms: DataFrame, joint: str) -> DataFrame:
    """(key, term, place, width): where a term's units stand one after the other among the text's units."""
    listed = cut_lineage(terms.filter(F.size("units") > 0).dropDuplicates(["term"]))
    return unit_places(df, key, units, listed, joint).join(listed.select("term"), "term").select(key, "term", "place", "width")


def _runs_of(terms: DataFrame) -> DataFrame:
    return terms.select("term").filter("term <> ''").distinct().select("term", F.split("term", RUNS).alias("units"))


def word_places(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """Like :func:`word_hits`, with some runs that are no terms; a join with the terms sorts them out."""
    return unit_places(df, key, F.split(squash(text), RUNS), cut_lineage(_runs_of(terms)), "")


def word_hits(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term, place, width) of every whole-word term of the squashed text; places count runs."""
    return unit_hits(df, key, F.split(squash(text), RUNS), _runs_of(terms), "")


def _runs_of_signs(text: Column, terms: DataFrame, shortest: int) -> Column:
    """The parts of a text that are long enough for a term, each once.

    Parts end at signs that no term has, told for the 128 first; so a term stands in one part, whole.
    """
    signs = terms.select(F.explode(F.array_distinct(F.split("term", ""))).alias("sign")).filter("sign <> '' and ascii(sign) < 128")
    used = {ord(r[0]) for r in signs.distinct().collect()}  # 128 at most
    ends = "".join(rf"\x{n:02x}" for n in range(128) if n not in used)
    sign = f"[^{ends}]" if ends else r"[\s\S]"
    return F.array_distinct(F.regexp_extract_all(blank(text), F.lit(f"{sign}{{{shortest}}}{sign}*"), F.lit(0)))


def substring_places(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term): strings of the text that may be terms; none that is one is left out, some come often.

    ``terms`` has terms that are not empty, and is read some times.  Texts fall into the runs of signs that terms have, and a
    run that comes again in a text is passed over.  A place is told by the head of the terms that
    start there; where a head stands, the strings of the lengths that terms have are looked up as a whole.  Runs are
    cut into pieces first, so that a place is found from the start of its piece.
    """
    listed = terms.select("term", F.length("term").alias("width"), F.substring("term", 1, HEAD).alias("head"))
    widths = sorted(r[0] for r in listed.select("width").distinct().collect())  # a few numbers
    if not widths:
        return df.select(key).limit(0).withColumn("term", F.lit(""))
    step = max(64, widths[-1])
    runs = df.select(key, _runs_of_signs(text, terms, widths[0]).alias("_r")).select(key, F.explode_outer("_r").alias("_run")).filter("_run is not null")
    pieces = F.when(F.length("_run") <= step, F.array("_run")).otherwise(F.regexp_extract_all("_run", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    cut = runs.select(key, pieces.alias("_p")).select(key, "_p", F.posexplode_outer("_p").alias("_i", "_own"))
    wide = cut.select(key, F.concat("_own", F.coalesce(F.get("_p", F.col("_i") + 1), F.lit(""))).alias("_ahead"), F.length("_own").alias("_n"))
    long = wide.withColumn("_len", F.length("_ahead")).withColumn("_last", F.least("_n", F.col("_len") - widths[0] + 1))  # behind it no term has room
    places = long.filter("_last > 0").select(key, "_ahead", "_len", F.explode_outer(F.sequence(F.lit(1), F.col("_last"))).alias("_at"))
    starts = lambda n: F.when(F.col("_at") + (n - 1) <= F.col("_len"), F.substring("_ahead", F.col("_at"), F.lit(n)))
    sizes = sorted({min(w, HEAD) for w in widths})
    if len(sizes) == 1:
        heads = places.withColumns({"head": starts(sizes[0]), "size": F.lit(sizes[0])})
    else:
        heads = places.select("*", F.explode(F.array(*[F.struct(starts(n).alias("head"), F.lit(n).alias("size")) for n in sizes])).alias("h")).select(
            key, "_ahead", "_len", "_at", "h.*")
    headed = keep_known(heads, "head", listed.select("head").distinct(), "head")
    each = headed.select(key, F.explode(F.array(*[F.when(F.col("size") == min(w, HEAD), starts(w)) for w in widths])).alias("term"))
    return keep_known(each, "term", listed, "term")


def substring_hits(df: DataFrame, key: str, text: Column, terms: DataFrame) -> DataFrame:
    """(key, term): the terms that stand anywhere in the text, each once.  An empty term stands in every text."""
    given = cut_lineage(terms.select("term").distinct())
    hits = substring_places(df, key, text, given.filter("term <> ''")).join(given, "term").select(key, "term").distinct()
    return hits.union(df.select(key).withColumn("term", F.lit(""))) if given.filter("term = ''").count() else hits


def with_classes(df: DataFrame, key: str, text: Column, vocab: DataFrame, rule: str, out: str) -> DataFrame:
    """Substring classes from a table (name, term, pos), in the pick rules of ``functions.text``.

    ``first``: the class whose first term is declared first (M2).  ``longest``: the class of the longest
    term, declared order on equal length (M3).  ``all``: every class with a term, in declared order (M4).
    Texts without a hit give null, or an empty array.
    """
    vocab = cut_lineage(vocab.select("name", "term", "pos"))
    classes = vocab.withColumn("first", F.min("pos").over(Window.partitionBy("name")))
    hits = substring_places(df, key, text, cut_lineage(vocab.select("term").filter("term <> ''").distinct()))
    if vocab.filter("term = ''").count():
        hits = hits.union(df.select(key).withColumn("term", F.lit("")))
    hits = hits.join(classes, "term")
    if rule == "all":
        told = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("first", "name"))), lambda s: s["name"]).alias(out))
        return df.join(told, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    by = F.struct("first", "pos") if rule == "first" else F.struct(-F.length("term"), F.col("pos"))
    return df.join(hits.groupBy(key).agg(F.min_by("name", by).alias(out)), key, "left")


def _ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def phrase_tokens(df: DataFrame, key: str, text: Column, phrases: DataFrame, out: str, max_words: int = 4) -> DataFrame:
    """Adds ``out``: the tokens of a query, the longest known phrase at each place being one token (M8).

    ``phrases`` has term, of any number of rows.  Spans of phrases come from :func:`unit_hits`; one fold per
    text goes over them by place, the longest first, and takes a span that starts behind the last one taken.
    """
    plain = F.trim(F.regexp_replace(F.translate(blank(text), ",，", "  "), r"\s+", " "))
    tokens = F.filter(F.split(plain, " "), lambda t: t != "")
    terms = phrases.select(_ascii_lower(F.col("term")).alias("term")).filter("term <> ''").withColumn("units", F.split("term", " ")).filter(
        F.size("units").between(2, max_words))
    hits = unit_hits(df, key, F.transform(tokens, _ascii_lower), terms, " ")
    spans = hits.groupBy(key).agg(F.collect_set(F.struct("place", (-F.col("width")).alias("less"))).alias("_found")).select(
        key, F.transform(F.array_sort("_found"), lambda s: F.struct(s["place"].alias("place"), (-s["less"]).alias("width"))).alias("_spans"))
    none = F.array().cast("array<struct<place:int,width:int>>")
    end = lambda s: s["place"] + s["width"]
    taken = F.aggregate(F.coalesce("_spans", none), none, lambda got, s: F.when(
        (F.size(got) == 0) | (s["place"] >= end(F.element_at(got, -1))), F.concat(got, F.array(s))).otherwise(got))
    rows = df.join(spans, key, "left").withColumn("_tokens", tokens).withColumn("_taken", taken)
    behind = lambda i: F.when(i > 0, end(F.get("_taken", i - 1))).otherwise(0)
    parts = F.transform("_taken", lambda s, i: F.concat(
        F.slice("_tokens", behind(i) + 1, s["place"] - behind(i)), F.array(F.array_join(F.slice("_tokens", s["place"] + 1, s["width"]), " "))))
    tail = F.slice("_tokens", behind(F.size("_taken")) + 1, F.size("_tokens"))
    return rows.withColumn(out, F.concat(F.flatten(parts), tail)).drop("_tokens", "_spans", "_taken")
