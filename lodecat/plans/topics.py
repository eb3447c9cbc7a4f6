"""Topics from texts and search keywords from topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions.text import lit_array, ordered_union
from lodecat.operators.order import top_per_key
from lodecat.plans.knowledge import NONE, Knowledge

# Weight of a keyword by what it combines.
COMBINATIONS = {"disease_omics": 1.0, "organ_omics": 0.8, "disease_organ": 0.6,
                "disease_only": 0.5, "organ_only": 0.4, "omics_only": 0.3, "extra": 0.2}
TIERS = (1.0, 0.8, 0.5)


def parse_topics(df: DataFrame, text: str, know: Knowledge) -> DataFrame:
    """Conditions, organs, assays and species of topic texts, with the usual defaults."""
    rows = know.analyze(df, text)
    rows = rows.withColumn("_more", F.array_join("expanded_terms", " "))
    rows = know.analyze(rows, "_more", "x_")
    words = F.split(F.trim(F.col(text)), r"\s+")
    both = lambda f: ordered_union(F.col(f), F.col(f"x_{f}"))
    rows = rows.withColumns({f: both(f) for f in ("diseases", "organs", "omics_types",
                                                  "species")})
    loose = F.flatten(F.transform(words, know.expand))
    known = lambda d: F.array_distinct(F.filter(loose, lambda w: d.canonical(w).isNotNull()))
    or_else = lambda f, other: F.when(F.size(f) > 0, F.col(f)).otherwise(other)
    return rows.withColumns({
        "diseases": or_else("diseases", known(know.disease)),
        "organs": or_else("organs", known(know.organ)),
        "omics_types": or_else("omics_types", lit_array(terms.DEFAULT_TOPIC_ASSAYS)),
        "species": or_else("species", lit_array(["Homo sapiens"])),
        "keywords_used": F.col("expanded_terms"),
    }).drop("_more", *[f"x_{f}" for f in ("diseases", "organs", "omics_types", "species",
                                          "expanded_terms", "confidence")])


def disease_tier(name: Column) -> Column:
    low = F.lower(name)
    return (F.when(low.isin(*terms.TIER_ONE), TIERS[0])
            .when(low.isin(*terms.TIER_THREE), TIERS[2]).otherwise(TIERS[1]))


def generate_keywords(topics: DataFrame, know: Knowledge, most: int = 100) -> DataFrame:
    """(topic_id, keyword, weight, rank): dimension products, each keyword once, the best
    ``most`` (C6, J12, T6).

    The dimensions of a topic are short lists in its row; their products are made in the row
    and spread as rows before keywords are merged.
    """
    every = lambda names, one: F.array_distinct(F.flatten(F.transform(names, one)))
    rows = topics.select(
        "topic_id",
        every(F.col("diseases"), lambda d: know.disease.names_of(d, "synonyms")).alias("d"),
        every(F.col("organs"), lambda o: know.organ.names_of(o, "synonyms")).alias("o"),
        every(F.col("omics_types"), lambda a: know.assay.names_of(a, "aliases")).alias("a"),
        F.coalesce("extra_keywords", F.array().cast(NONE)).alias("e"))
    d, o, a = F.col("d"), F.col("o"), F.col("a")
    kw = lambda text, weight: F.struct(
        text.alias("keyword"), weight.cast("double").alias("weight"))
    w = {k: F.lit(v) for k, v in COMBINATIONS.items()}
    pair = lambda xs, ys, weight: F.flatten(F.transform(xs, lambda x: F.transform(
        ys, lambda y: kw(F.concat(x, F.lit(" "), y), weight(x)))))
    one = lambda xs, weight: F.transform(xs, lambda x: kw(x, weight(x)))
    parts = F.concat(
        pair(d, a, lambda x: disease_tier(x) * w["disease_omics"]),
        pair(o, a, lambda x: w["organ_omics"]),
        pair(d, o, lambda x: disease_tier(x) * w["disease_organ"]),
        one(d, lambda x: disease_tier(x) * w["disease_only"]),
        pair(o, a, lambda x: w["organ_only"]),
        one(a, lambda x: w["omics_only"]),
        one(F.col("e"), lambda x: w["extra"]))
    spread = rows.select("topic_id", F.posexplode(parts).alias("seq", "k")).select(
        "topic_id", "seq", "k.keyword", "k.weight",
        F.trim(F.regexp_replace(F.lower("k.keyword"), r"\s+", " ")).alias("norm"))
    once = spread.groupBy("topic_id", "norm").agg(
        F.min_by(F.struct("seq", "keyword", "weight"), "seq").alias("_k")).select(
            "topic_id", "_k.*")
    return top_per_key(once, ["topic_id"], [F.col("weight").desc(), F.col("seq")], most)


def from_dimensions(topics: DataFrame) -> DataFrame:
    """Topics whose dimensions the user gave; only the species has a default."""
    empty = F.array().cast(NONE)
    return topics.withColumns({
        **{f: F.coalesce(f, empty) for f in ("diseases", "organs", "omics_types")},
        "species": F.when(F.size(F.coalesce("species", empty)) > 0, F.col("species"))
                    .otherwise(lit_array(["Homo sapiens"]))})
