"""One search over all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.functions import score
from lodecat.functions.normalize import (
    condition_in_text, normalize_platform, normalize_species, organ_in_text,
)
from lodecat.functions import classify
from lodecat.functions.parse import is_series_id
from lodecat.functions.text import blank, join_text
from lodecat.operators import aggregates, joins
from lodecat.operators.order import first_per_key, top_per_key
from lodecat.operators.store import union_sources

RESULT = ["gse_id", "title", "organism", "platform", "sample_count", "abstract",
          "match_source", "match_score", "has_gse", "pos"]
SOURCES = ["geo", "sra", "pubmed", "bioproject"]


def _result(df: DataFrame, source: str, value: Column, has_gse: Column) -> DataFrame:
    text = lambda c: F.col(c) if c in df.columns else F.lit("")
    return df.select(
        "gse_id", text("title").alias("title"), text("organism").alias("organism"),
        text("platform").alias("platform"),
        (F.col("sample_count") if "sample_count" in df.columns else F.lit(0)).cast("long")
        .alias("sample_count"), text("abstract").alias("abstract"),
        F.lit(source).alias("match_source"), value.cast("double").alias("match_score"),
        has_gse.alias("has_gse"), F.col("pos").cast("long").alias("pos"))


def from_geo(series: DataFrame, query: str) -> DataFrame:
    """Scored series records."""
    text = F.lower(join_text(F.col("title"), F.col("abstract"), F.col("overall_design")))
    scored = series.withColumn("_text", text)
    return _result(scored, "geo", score.source_match(F.col("_text"), query), F.lit(True))


def from_sra(packages: DataFrame, authority: DataFrame, query: str) -> DataFrame:
    """Studies rolled up to series that exist, and studies alone if their title fits (D8,
    J6, F7)."""
    known = authority.select(F.col("gse_id").alias("_known")).distinct()
    studies = aggregates.study_rollup(packages).join(
        known, F.col("gse_id") == F.col("_known"), "left")
    good = F.col("has_gse") & F.col("_known").isNotNull()
    # A series nobody knows falls back to its first study, behind studies without a series.
    keyed = studies.withColumns({
        "gse_id": F.when(good, F.col("gse_id")).otherwise(F.col("srp_id")),
        "_late": F.col("has_gse").cast("int"), "has_gse": good}).drop("_known")
    first = first_per_key(keyed, ["gse_id"], [F.col("_late"), F.col("pos")])
    fits = first.filter(F.col("has_gse") | score.title_relevant(
        F.lower(blank(F.col("title"))), query))
    return _result(fits, "sra", F.when(F.col("has_gse"), 0.6).otherwise(0.4), F.col("has_gse"))


def from_pubmed(papers: DataFrame, links: DataFrame, authority: DataFrame, query: str,
                most: int = 5) -> DataFrame:
    """Series that fitting papers name or link to, the first few per paper."""
    text = F.lower(join_text(F.col("title"), F.col("abstract")))
    fit = papers.filter(score.title_relevant(text, query))
    named = joins.paper_links(fit, links.filter(F.col("gse_id").rlike("^GSE[0-9]{1,7}$")))
    valid = joins.known_only(named, authority)
    lead = top_per_key(valid, ["pmid"], [F.col("place"), F.col("gse_id")], most, rank="_r")
    rows = lead.join(fit.select("pmid", "title", "abstract", "pos"), "pmid").withColumn(
        "pos", F.col("pos") * most + F.col("_r"))
    return _result(rows, "pubmed", F.lit(0.5), F.lit(True))


def federated_search(query: str, geo: DataFrame | None = None,
                     packages: DataFrame | None = None, papers: DataFrame | None = None,
                     links: DataFrame | None = None, authority: DataFrame | None = None,
                     threshold: float = 0.30,
                     samples: DataFrame | None = None) -> DataFrame:
    """Merged, de-duplicated rows of all given sources above the threshold.

    Sources count in the order geo, sra, pubmed; a missing one gives nothing.
    """
    if authority is None and geo is not None:
        authority = geo.select("gse_id")
    parts = {
        "geo": None if geo is None else from_geo(geo, query),
        "sra": None if packages is None else from_sra(packages, authority, query),
        "pubmed": None if papers is None else from_pubmed(papers, links, authority, query),
    }
    merged = deduplicate(union_sources(parts))
    kept = merged.filter(F.col("match_score") >= threshold)
    return kept if samples is None else joins.attach_samples(kept, samples)


def deduplicate(rows: DataFrame) -> DataFrame:
    """First row per dataset in source order."""
    return first_per_key(rows, ["gse_id"], [F.col("source_rank"), F.col("pos")])


def extract_studies(packages: DataFrame) -> DataFrame:
    """Packages to dataset records: key, normal names, inferred fields, access.

    ``packages`` has srp_id, gse_ids, title, organism, instrument, library_strategy,
    library_source, sample_count, bioproject_ids, accession_auth, study_alias.
    """
    c = F.col
    first = F.get("gse_ids", F.lit(0))
    low = packages.withColumn("_low", F.lower(blank(c("title")))).withColumn(
        "_platform", normalize_platform(c("instrument")))
    return low.select(
        F.coalesce(first, F.concat(F.lit("SRP:"), c("srp_id"))).alias("gse_id"), "title",
        normalize_species(c("organism")).alias("organism"),
        F.coalesce(condition_in_text(c("_low")), F.lit("")).alias("disease"),
        F.coalesce(organ_in_text(c("_low")), F.lit("")).alias("organ"),
        classify.assay_from_library(c("library_strategy"), c("title"), c("_platform"))
        .alias("omics_type"),
        classify.granularity_from_library(c("library_source"), c("title"), c("sample_count"))
        .alias("omics_granularity"),
        "sample_count", c("_platform").alias("platform"),
        F.when(blank(c("srp_id")) != "", F.array("srp_id"))
        .otherwise(F.array().cast("array<string>")).alias("sra_ids"),
        "bioproject_ids", first.isNotNull().alias("has_gse"),
        classify.access_from_study(c("accession_auth"), c("study_alias"), c("srp_id"))
        .alias("access_type"))


def cited_series(papers: DataFrame, links: DataFrame) -> DataFrame:
    """(pmid, gse_id) that paper texts or links name (C20)."""
    return joins.paper_links(papers, links.filter(is_series_id(F.col("gse_id")))).select(
        "pmid", "gse_id")
