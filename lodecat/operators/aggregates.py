"""Counts and roll-ups.  All are partial aggregates, so a hot group is reduced before it
is shuffled; distinct counts go through (group, value) first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions.text import blank, has_any
from lodecat.operators.order import first_per_key


def review_summary(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per review status; no status reads pending."""
    status = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("pending"))
    return edges.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in terms.REVIEW_STATUSES])


def count_datasets(datasets: DataFrame, edges: DataFrame | None = None,
                   topic_id: str | None = None, review_status: str | None = None,
                   availability: str | None = None) -> DataFrame:
    """Distinct datasets of a topic, or all rows; a status needs a topic."""
    if availability:
        datasets = datasets.filter(F.col("availability_status") == availability)
    if topic_id is None:
        return datasets.agg(F.count(F.lit(1)).alias("n"))
    chosen = edges.filter(F.col("topic_id") == topic_id)
    if review_status:
        chosen = chosen.filter(F.col("review_status") == review_status)
    if availability:
        chosen = chosen.join(datasets.select("gse_id"), "gse_id", "left_semi")
    return chosen.agg(F.countDistinct("gse_id").alias("n"))


def availability_counts(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("availability_status").agg(F.count(F.lit(1)).alias("n"))


def top_organisms(datasets: DataFrame, n: int = 10) -> DataFrame:
    return (datasets.filter(blank(F.col("organism")) != "").groupBy("organism")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "organism").limit(n))


def topic_availability(view: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Availability counts of a joined topic view."""
    known = ["available", "unavailable", "restricted"]
    status = F.col("availability_status")
    return view.groupBy(*(by or [])).agg(
        *[F.count_if(status == s).alias(s) for s in known],
        F.count_if(F.col("access_type") == "controlled").alias("controlled"),
        (F.count(F.lit(1)) - F.count_if(F.coalesce(status.isin(*known), F.lit(False))))
        .alias("unverified"))


def result_stats(view: DataFrame, total_found: int | Column | None = None) -> DataFrame:
    """Returned, single-cell, bulk and perturbation counts of a result."""
    bulk = F.col("data_type").isin("RNA-seq", "microarray") & ~F.col("single_cell")
    returned = F.count(F.lit(1))
    return view.agg(
        (F.lit(total_found) if total_found is not None else returned).alias("total_found"),
        returned.alias("returned"), F.count_if("single_cell").alias("single_cell"),
        F.count_if(bulk).alias("bulk"), F.count_if("has_perturbation").alias("perturbation"))


def source_stats(rows: DataFrame) -> DataFrame:
    """Rows and mean score per source."""
    return rows.groupBy("match_source").agg(
        F.count(F.lit(1)).alias("n"), F.avg("match_score").alias("mean_score"))


def reduction_rates(raw: DataFrame, merged: DataFrame, kept: DataFrame) -> DataFrame:
    """Share removed by merging and by the threshold (D7); three one-row tables."""
    a = raw.agg(F.count(F.lit(1)).alias("raw"))
    b = merged.agg(F.count(F.lit(1)).alias("merged"))
    c = kept.agg(F.count(F.lit(1)).alias("kept"), F.avg("match_score").alias("mean_score"))
    share = lambda x, y: F.when(F.col(y) > 0, 1 - F.col(x) / F.col(y)).otherwise(0.0)
    return (a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k")
            .join(c.withColumn("_k", F.lit(1)), "_k").drop("_k")
            .withColumn("dedup_rate", share("merged", "raw"))
            .withColumn("filter_rate", share("kept", "merged")))


def study_rollup(packages: DataFrame) -> DataFrame:
    """One row per series from its experiment packages.

    ``packages`` has gse_id ('' without one), srp_id, srx_id, srr_id, bioproject_id,
    sample_count, run_count, pos and the representative columns title, organism, platform.
    Samples are distinct experiments, else the larger of summed samples and runs.  Packages
    without a series collapse to the first per study.
    """
    rep = ["srp_id", "title", "organism", "platform"]
    linked = packages.filter(blank(F.col("gse_id")) != "")
    lead = F.min_by(F.struct(*rep), "pos")
    per_series = linked.groupBy("gse_id").agg(
        lead.alias("_rep"), F.sum("sample_count").alias("_samples"),
        F.sum("run_count").alias("_runs"), F.min("pos").alias("pos"))
    # Distinct counts by way of (series, kind, id): a hot series spreads over its ids.
    kinds = {"study": "n_studies", "run": "n_runs", "project": "n_projects",
             "experiment": "n_experiments"}
    counts = study_links(linked).groupBy("gse_id").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()])
    out = per_series.join(counts, "gse_id", "left").fillna(0, list(kinds.values()))
    series = out.select(
        "gse_id", "_rep.*",
        F.when(F.col("n_experiments") > 0, F.col("n_experiments"))
        .otherwise(F.greatest("_samples", "_runs")).alias("sample_count"),
        "n_studies", "n_runs", "n_projects", F.lit(True).alias("has_gse"), "pos")
    alone = (first_per_key(packages.filter(blank(F.col("gse_id")) == ""), ["srp_id"],
                           [F.col("pos")])
             .select(F.col("srp_id").alias("gse_id"), *rep,
                     F.col("sample_count").cast("long").alias("sample_count"),
                     F.lit(1).cast("long").alias("n_studies"),
                     (blank(F.col("srr_id")) != "").cast("long").alias("n_runs"),
                     (blank(F.col("bioproject_id")) != "").cast("long").alias("n_projects"),
                     F.lit(False).alias("has_gse"), "pos"))
    return series.unionByName(alone)


def study_links(packages: DataFrame) -> DataFrame:
    """(gse_id, kind, linked_id, place) of every study, run, project and experiment of a
    series: the id lists of D8 as rows, in first-seen order, so that no list grows without
    bound."""
    linked = packages.filter(blank(F.col("gse_id")) != "")
    pairs = linked.select("gse_id", "pos", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).alias("linked_id"))
        for kind, c in (("study", "srp_id"), ("run", "srr_id"), ("project", "bioproject_id"),
                        ("experiment", "srx_id"))])))
    return (pairs.filter(blank(F.col("linked_id")) != "")
            .groupBy("gse_id", "kind", "linked_id").agg(F.min("pos").alias("place")))


def cache_stats(index: DataFrame, as_of: datetime, ttl_hours: float) -> DataFrame:
    """Total, valid and expired entries and bytes."""
    old = (F.lit(as_of).cast("timestamp").cast("double")
           - F.col("cached_at").cast("timestamp").cast("double")) / 3600 > ttl_hours
    return index.agg(F.count(F.lit(1)).alias("total"), F.count_if(~old).alias("valid"),
                     F.count_if(old).alias("expired"), F.sum("bytes").alias("bytes"))


def check_stats(results: DataFrame) -> DataFrame:
    """Check results per status."""
    status = F.col("availability_status")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s)
          for s in ("available", "unavailable", "restricted", "unverified")])


def verdict(text: Column) -> Column:
    """Condition and method evidence to one of four verdicts."""
    disease = has_any(text, terms.VERDICT_DISEASE_TERMS)
    cells = has_any(text, terms.VERDICT_SINGLE_CELL_TERMS)
    return (F.when(disease & cells, "RELEVANT").when(disease, "PARTIAL")
            .when(cells, "NOISE").otherwise("GARBAGE"))


def overview(datasets: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of both tables."""
    a = datasets.agg(F.count(F.lit(1)).alias("n")).select(F.lit("datasets").alias("what"), "n")
    b = topics.agg(F.count(F.lit(1)).alias("n")).select(F.lit("topics").alias("what"), "n")
    return a.unionByName(b)


def vocabulary_audit(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(issue, domain, name): keys that differ from their canonical name, names in more than
    one vocabulary, and links to names that do not exist (D15)."""
    row = lambda df, issue, domain, name: df.select(
        F.lit(issue).alias("issue"), domain.alias("domain"), name.alias("name"))
    renamed = row(entries.filter(F.col("key") != F.col("canonical")), "key differs",
                  F.col("domain"), F.col("key"))
    shared = (entries.select("domain", F.lower("canonical").alias("name")).distinct()
              .groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    known = entries.select("domain", F.col("key").alias("known")).distinct()
    lost = lambda side: edges.select("domain", F.col(side).alias("known")).join(
        known, ["domain", "known"], "left_anti").distinct()
    return (renamed
            .unionByName(row(shared, "several vocabularies", F.lit("*"), F.col("name")))
            .unionByName(row(lost("parent"), "missing parent", F.col("domain"), F.col("known")))
            .unionByName(row(lost("child"), "missing child", F.col("domain"), F.col("known"))))
