"""Matching free text against a vocabulary table.

``vocab`` has domain, term (lower case), canonical, kind, weight, granularity, pos.  A
vocabulary of checked, small size is read once and matched inside the row; a larger one is
joined with the places of the text that may hold one of its terms.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.functions.text import best_phrase, blank, squash
from lodecat.operators.anchored import word_hits, word_places
from lodecat.session import spread

INLINE_TERMS = 5000
FIELDS = ("canonical", "weight", "granularity")


def ranked(vocab: DataFrame, *more: str) -> DataFrame:
    """Terms with their rank key: longest first, then declared order."""
    return vocab.select(
        "term", *FIELDS, *more, F.struct((-F.length("term")).alias("length"), "pos").alias("rank"))


def small_vocabularies(vocab: DataFrame,
                       limit: int = INLINE_TERMS) -> dict[str, list[tuple]] | None:
    """Terms per domain, best first, read in one go; None when there are more than ``limit``."""
    rows = ranked(vocab, "domain").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rows.sort(key=lambda r: (r["rank"]["length"], r["rank"]["pos"]))
    out: dict[str, list[tuple]] = {}
    for r in rows:
        out.setdefault(r["domain"], []).append((r["term"], *(r[f] for f in FIELDS)))
    return out


def small_terms(vocab: DataFrame, limit: int = INLINE_TERMS) -> list[tuple] | None:
    """All terms of one vocabulary best first, or None when there are more than ``limit``."""
    found = small_vocabularies(vocab.withColumn("domain", F.lit("")), limit)
    return None if found is None else found.get("", [])


def match_best(df: DataFrame, key: str, text: Column, vocab: DataFrame, out: str,
               limit: int = INLINE_TERMS) -> DataFrame:
    """Adds ``out``: struct(canonical, weight, granularity) of the best whole-word term, or
    null (M1)."""
    terms = small_terms(vocab, limit)
    if terms is not None:
        if not terms:
            return df.withColumn(out, F.lit(None).cast(
                "struct<canonical:string,weight:double,granularity:string>"))
        found = spread(df).withColumn("_t", squash(text)).withColumn(
            "_b", best_phrase(F.col("_t"), terms, FIELDS))
        return found.withColumn(out, F.when(F.col("_b").isNotNull(), F.struct(
            *[F.col("_b")[f].alias(f) for f in FIELDS]))).drop("_t", "_b")
    best = (match_all(df, key, text, vocab).groupBy(key)
            .agg(F.min_by(F.struct(*FIELDS), "rank").alias(out)))
    return df.join(best, key, "left")


def match_all(df: DataFrame, key: str, text: Column, vocab: DataFrame) -> DataFrame:
    """(key, term, canonical, weight, granularity, rank) of every whole-word term, by
    :func:`lodecat.operators.anchored.word_hits`: only places that may hold a term are joined."""
    terms = ranked(vocab).groupBy("term").agg(
        F.min_by(F.struct(*FIELDS, "rank"), "rank").alias("_best")).select("term", "_best.*")
    hits = word_hits(df, key, text, terms).select(key, "term").distinct()
    return hits.join(terms, "term").select(key, "term", *FIELDS, "rank")


def best_per_domain(df: DataFrame, key: str, text: Column, vocab: DataFrame, out: Mapping[str, str]) -> DataFrame:
    """Adds a struct(canonical, weight, granularity) for each domain of ``out`` (domain to column): its best
    whole-word term in the text, or null.  One scan serves all domains; ``key`` is unique."""
    terms = ranked(vocab.filter(F.col("domain").isin(*out) & (F.col("term") == F.lower("term"))), "domain")
    hits = word_places(df, key, text, terms).select(key, "term").join(terms.select("term", "domain", "rank"), "term")
    first = hits.groupBy(key, "domain").agg(F.min(F.struct("rank", "term")).alias("_f"))  # narrow rows; the rest is told of the best alone
    told = terms.groupBy("domain", "term", "rank").agg(F.min(F.struct(*FIELDS)).alias("_v"))
    won = first.select(key, "domain", "_f.*").join(told, ["domain", "term", "rank"])
    best = won.groupBy(key).agg(*[F.min(F.when(F.col("domain") == d, F.col("_v"))).alias(c) for d, c in out.items()])
    return df.join(best, key, "left")


def first_alias(vocab: DataFrame) -> DataFrame:
    """alias -> canonical, the first declared wins."""
    return vocab.groupBy(F.col("term").alias("alias")).agg(
        F.min_by("canonical", "pos").alias("canonical"))


def resolve_alias(df: DataFrame, name: Column, vocab: DataFrame, out: str = "canonical",
                  keep_unknown: bool = True) -> DataFrame:
    """Exact alias to canonical name, ignoring case and outer blanks.

    No hint: the size Spark measures decides between broadcast and shuffle.
    """
    aliases = first_alias(vocab).select(F.col("alias").alias("_alias"),
                                        F.col("canonical").alias("_canonical"))
    joined = df.join(aliases, F.lower(F.trim(blank(name))) == F.col("_alias"), "left")
    value = F.coalesce(F.col("_canonical"), F.trim(blank(name))) if keep_unknown \
        else F.col("_canonical")
    return joined.withColumn(out, value).drop("_alias", "_canonical")


def detect_by_keyword(df: DataFrame, text: Column, classes: Sequence[tuple[str, Sequence[str]]],
                      confidence: float = 0.5) -> DataFrame:
    """One row per class with a keyword inside the text."""
    from lodecat.functions.text import all_classes
    low = df.withColumn("_low", F.lower(blank(text)))
    return (low.withColumn("canonical", F.explode(all_classes(F.col("_low"), classes)))
            .withColumn("confidence", F.lit(confidence)).drop("_low"))
