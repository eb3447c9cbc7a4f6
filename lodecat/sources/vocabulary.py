"""Vocabulary files to term and edge tables.

A file holds ``{root: {name: {canonical, synonyms, aliases, search_terms, ...}}}``.  Rows keep
their declared order in ``pos``, which the pick rules need.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions.text import blank, lit_map
from lodecat.sources.landed import documents

SEED = Path(__file__).parent.parent / "seed"
ROOTS = {"organ": "organs", "assay": "omics_types", "disease": "diseases",
         "mesh": "mesh_synonyms"}
_LIST = "array<string>"
ENTRY = ("struct<canonical:string,synonyms:array<string>,aliases:array<string>,"
         "keywords:array<string>,search_terms:array<string>,search_boost_terms:array<string>,"
         "adjective:string,parent:string,children:array<string>,related_organs:array<string>,"
         "related_diseases:array<string>,related_species:array<string>,full_name:string,"
         "category:string,uberon_id:string,mesh_id:string,doid_id:string,"
         "subtypes:map<string,string>>")


def parse_entries(df: DataFrame, domain: str, roots: Sequence[str] | str) -> DataFrame:
    """Vocabulary entries of ``body`` documents, one row per name."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    maps = [F.from_json("body", f"struct<{r}:map<string,{ENTRY}>>")[r] for r in roots]
    rows = df.select("seq", F.posexplode(F.coalesce(*maps)).alias("place", "key", "e"))
    lists = ["synonyms", "aliases", "keywords", "search_terms", "search_boost_terms",
             "children", "related_organs", "related_diseases", "related_species"]
    texts = ["adjective", "parent", "full_name", "category", "uberon_id", "mesh_id", "doid_id"]
    return rows.select(
        F.lit(domain).alias("domain"), "key",
        F.coalesce(F.nullif("e.canonical", F.lit("")), "key").alias("canonical"),
        *[F.coalesce(f"e.{c}", F.array().cast(_LIST)).alias(c) for c in lists],
        *[blank(F.col(f"e.{c}")).alias(c) for c in texts],
        F.col("e.subtypes").alias("subtypes"), "seq", "place")


def read_ontology(spark: SparkSession, path: str, domain: str,
                  root: str | Sequence[str] | None = None, lines: bool = False) -> DataFrame:
    return parse_entries(documents(spark, path, lines), domain,
                         root or ([ROOTS[domain], "synonym_groups"] if domain == "mesh"
                                  else ROOTS[domain]))


def seed_entries(spark: SparkSession, domains: Sequence[str] = tuple(ROOTS)) -> DataFrame:
    """The small vocabulary that ships with the package (four files of a few kilobytes, read
    by the driver because only it is sure to have the package folder)."""
    out = None
    for d in domains:
        body = pa.table({"body": [(SEED / f"{d}.json").read_text("utf-8")], "seq": [d]})
        part = parse_entries(spark.createDataFrame(body), d, ROOTS[d])
        out = part if out is None else out.unionByName(part)
    return out


def entry_granularity(category: Column, key: Column) -> Column:
    low = F.lower(category)
    return (F.when(F.contains(low, F.lit("single"))
                   | F.contains(F.lower(key), F.lit("single-cell")), "single_cell")
            .when(F.contains(low, F.lit("spatial")), "spatial").otherwise("bulk"))


# Weight of a term by vocabulary and kind.
WEIGHTS = {
    "organ": [("canonical", 1.0), ("synonym", 0.9), ("search_term", 0.7), ("adjective", 0.6)],
    "assay": [("canonical", 1.0), ("alias", 0.9), ("keyword", 0.8)],
    "disease": [("canonical", 0.9), ("synonym", 0.8), ("search_term", 0.7)],
    "mesh": [("canonical", 1.0), ("synonym", 0.9), ("search_term", 0.7)],
}
_SOURCE = {"synonym": "synonyms", "alias": "aliases", "keyword": "keywords",
           "search_term": "search_terms", "child": "children", "organ": "related_organs",
           "species": "related_species", "boost": "search_boost_terms"}


def vocab_terms(entries: DataFrame, matching_only: bool = False) -> DataFrame:
    """(domain, term, label, canonical, kind, weight, granularity, pos) of all kinds.

    ``matching_only`` keeps the kinds that text is matched with, weighted.  ``pos`` follows
    the declared order: entry by entry, kind by kind, term by term.
    """
    single = {"canonical": F.col("key"), "adjective": F.col("adjective"),
              "parent": F.col("parent"), "uberon_id": F.col("uberon_id"),
              "mesh_id": F.col("mesh_id"), "doid_id": F.col("doid_id")}
    kinds = ["canonical", "synonym", "alias", "keyword", "search_term", "adjective", "child",
             "parent", "organ", "species", "boost", "uberon_id", "mesh_id", "doid_id"]
    weight = lambda kind: F.coalesce(*[
        F.when((F.col("domain") == d) & F.lit(k == kind), w)
        for d, pairs in WEIGHTS.items() for k, w in pairs])
    def block(n: int, kind: str) -> Column:
        words = F.array(single[kind]) if kind in single else F.col(_SOURCE[kind])
        return F.transform(words, lambda t, i: F.struct(
            F.lower(t).alias("term"), t.alias("label"), F.lit(kind).alias("kind"),
            weight(kind).cast("double").alias("weight"), F.lit(n).alias("k"), i.alias("i")))

    blocks = [block(n, k) for n, k in enumerate(kinds)]
    rows = entries.withColumn("t", F.explode(F.flatten(F.array(*blocks)))).filter("t.term <> ''")
    if matching_only:
        rows = rows.filter("t.weight is not null")
    return rows.select(
        "domain", "t.term", "t.label", "canonical", "t.kind",
        F.coalesce("t.weight", F.lit(0.0)).alias("weight"),
        F.when(F.col("domain") == "assay", entry_granularity(F.col("category"), F.col("key")))
        .otherwise("").alias("granularity"),
        F.struct("seq", "place", F.col("t.k").alias("k"), F.col("t.i").alias("i")).alias("pos"))


def vocab_edges(entries: DataFrame) -> DataFrame:
    """(domain, parent, child) from both the parent and the children fields."""
    up = entries.filter("parent <> ''").select(
        "domain", "parent", F.col("key").alias("child"))
    down = entries.select("domain", F.col("key").alias("parent"), F.explode("children").alias("child"))
    return up.unionByName(down).distinct()


def keyword_vocab(spark: SparkSession, words: Sequence[str], domain: str = "disease") -> DataFrame:
    """Weight-1 matching terms from a plain word list, named by the fixed names."""
    data = pa.table({"label": list(words), "n": list(range(len(words)))})
    df = spark.createDataFrame(data)
    low = F.lower("label")
    return df.select(
        F.lit(domain).alias("domain"), low.alias("term"), "label",
        F.coalesce(F.element_at(lit_map(terms.DISEASE_NAMES), low), F.initcap("label"))
        .alias("canonical"), F.lit("keyword").alias("kind"), F.lit(1.0).alias("weight"),
        F.lit("").alias("granularity"),
        F.struct(F.lit("").alias("seq"), F.lit(0).alias("place"), F.lit(0).alias("k"),
                 F.col("n").cast("int").alias("i")).alias("pos"))


def parse_keyword_lists(df: DataFrame, root: str) -> DataFrame:
    """Words of ``{root: [..]}`` or ``{root: {terms: [..]}}`` documents, in order."""
    plain = F.from_json("body", f"struct<{root}:array<string>>")[root]
    nested = F.from_json("body", f"struct<{root}:struct<terms:array<string>>>")[root]["terms"]
    return df.select("seq", F.posexplode(F.coalesce(nested, plain)).alias("place", "word"))


def read_keyword_lists(spark: SparkSession, path: str, root: str, lines: bool = False) -> DataFrame:
    return parse_keyword_lists(documents(spark, path, lines), root)


def keywords(default: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """A list given at run time replaces the landed one."""
    return default if override is None else override


def parse_abbreviations(df: DataFrame) -> DataFrame:
    """Abbreviations, keyed in upper case, with what they stand for."""
    return parse_entries(df, "abbreviation", "abbreviations").select(
        F.upper("key").alias("key"), "full_name", "search_terms", "related_diseases",
        "related_organs")


def read_abbreviations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return parse_abbreviations(documents(spark, path, lines))
