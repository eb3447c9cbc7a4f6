"""Aggregates D1-D15."""

from datetime import datetime

from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.operators import aggregates as a
from lodecat.operators.joins import topic_view
from lodecat.plans import sample_groups as sg
from lodecat.plans.reports import evaluate
from lodecat.sources import vocabulary as v
from workload.derived import table
from workload.joins import topics
from workload.registry import query
from workload.sources import part_entries
from workload.sqltext import any_

c, lit = F.col, F.lit


@query("d1_review_summary", "SELECT topic_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (review_status = '{s}') AS {s}" for s in terms.REVIEW_STATUSES)
       + " FROM topic_datasets GROUP BY topic_id", "topic_datasets")
def d1(spark, sf):
    return a.review_summary(table(spark, sf, "topic_datasets"), ["topic_id"])


@query("d2_count_datasets", "SELECT 'all' AS what, count(*) AS n FROM datasets UNION ALL SELECT 'topic', count(DISTINCT gse_id) FROM topic_datasets WHERE topic_id = 'T5' AND review_status = "
       "'approved' UNION ALL SELECT 'available', count(DISTINCT gse_id) FROM topic_datasets JOIN datasets USING (gse_id) WHERE topic_id = 'T5' AND availability_status = 'available'",
       "datasets topic_datasets")
def d2(spark, sf):
    d, e = table(spark, sf, "datasets"), table(spark, sf, "topic_datasets")
    return (a.count_datasets(d).withColumn("what", lit("all"))
            .unionByName(a.count_datasets(d, e, "T5", "approved").withColumn("what", lit("topic")))
            .unionByName(a.count_datasets(d, e, "T5", availability="available").withColumn("what", lit("available"))))


@query("d3_availability_counts", "SELECT availability_status, count(*) AS n FROM datasets GROUP BY 1", "datasets")
def d3(spark, sf):
    return a.availability_counts(table(spark, sf, "datasets"))


@query("d4_top_organisms", "SELECT organism, count(*) AS n FROM datasets WHERE organism <> '' GROUP BY 1 ORDER BY n DESC, organism LIMIT 10", "datasets")
def d4(spark, sf):
    return a.top_organisms(table(spark, sf, "datasets"))


@query("d5_topic_availability", "SELECT topic_id, count(*) FILTER (availability_status = 'available') AS available, count(*) FILTER (availability_status = 'unavailable') AS unavailable, "
       "count(*) FILTER (availability_status = 'restricted') AS restricted, count(*) FILTER (access_type = 'controlled') AS controlled, count(*) FILTER (availability_status NOT IN "
       "('available', 'unavailable', 'restricted')) AS unverified FROM topic_datasets JOIN datasets USING (gse_id) GROUP BY topic_id", "topic_datasets datasets")
def d5(spark, sf):
    return a.topic_availability(topic_view(table(spark, sf, "topic_datasets"), table(spark, sf, "datasets")), ["topic_id"])


@query("d6_result_stats", "SELECT count(*) AS total_found, count(*) AS returned, count(*) FILTER (contains(title, 'ingle-cell')) AS single_cell, count(*) FILTER (omics_type IN ('RNA-seq', "
       "'microarray') AND NOT contains(title, 'ingle-cell')) AS bulk, count(*) FILTER (" + any_("lower(title)", [w for _, ws in terms.PERTURBATIONS for w in ws])
       + ") AS perturbation FROM datasets", "datasets")
def d6(spark, sf):
    from lodecat.functions.text import all_classes
    df = table(spark, sf, "datasets").withColumns({
        "data_type": c("omics_type"), "single_cell": F.contains("title", lit("ingle-cell")),
        "has_perturbation": F.size(all_classes(F.lower("title"), terms.PERTURBATIONS)) > 0})
    return a.result_stats(df)


@query("d7_source_stats", "SELECT match_source, count(*) AS n, round(avg(match_score), 6) AS mean_score FROM topic_datasets GROUP BY 1", "topic_datasets")
def d7(spark, sf):
    return a.source_stats(table(spark, sf, "topic_datasets")).withColumn("mean_score", F.round("mean_score", 6))


@query("d7_reduction_rates", ", m AS (SELECT gse_id, arg_min(match_score, edge_id) AS s FROM topic_datasets GROUP BY 1), n AS (SELECT (SELECT count(*) FROM topic_datasets) AS raw, count(*) AS "
       "merged, count(*) FILTER (s >= 0.3) AS kept, round(avg(s) FILTER (s >= 0.3), 6) AS mean_score FROM m) SELECT *, round(1 - merged / raw, 6) AS dedup_rate, round(1 - kept / merged, 6) AS "
       "filter_rate FROM n", "topic_datasets")
def d7b(spark, sf):
    from lodecat.operators.order import first_per_key
    raw = table(spark, sf, "topic_datasets").select("gse_id", "edge_id", "match_score")
    merged = first_per_key(raw, ["gse_id"], [c("edge_id")])
    out = a.reduction_rates(raw, merged, merged.filter("match_score >= 0.3"))
    return out.withColumns({x: F.round(x, 6) for x in ("mean_score", "dedup_rate", "filter_rate")})


ROLLUP = """SELECT gse_id, arg_min(title, pos) AS title, arg_min(srp_id, pos) AS srp_id, count(DISTINCT srx_id) AS sample_count, count(DISTINCT srp_id) AS n_studies,
 count(DISTINCT srr_id) AS n_runs, count(DISTINCT bioproject_id) AS n_projects, true AS has_gse FROM sra_packages WHERE gse_id <> '' GROUP BY gse_id UNION ALL
 SELECT srp_id, arg_min(title, pos), srp_id, 1, 1, 1, 1, false FROM sra_packages WHERE gse_id = '' GROUP BY srp_id"""


@query("d8_study_rollup", ROLLUP, "sra_packages")
def d8(spark, sf):
    return a.study_rollup(table(spark, sf, "sra_packages")).drop("organism", "platform", "pos")


@query("d8_study_links", "SELECT gse_id, 'study' AS kind, srp_id AS linked_id, min(pos) AS place FROM sra_packages WHERE gse_id <> '' GROUP BY ALL UNION ALL SELECT gse_id, 'run', srr_id, min(pos) "
       "FROM sra_packages WHERE gse_id <> '' GROUP BY ALL UNION ALL SELECT gse_id, 'project', bioproject_id, min(pos) FROM sra_packages WHERE gse_id <> '' GROUP BY ALL UNION ALL SELECT gse_id, 'experiment', srx_id, "
       "min(pos) FROM sra_packages WHERE gse_id <> '' GROUP BY ALL", "sra_packages")
def d8b(spark, sf):
    return a.study_links(table(spark, sf, "sra_packages"))


TIME = "CASE " + " ".join(f"WHEN regexp_matches(s, '(^|[_\\-.\\s]){w}($|[_\\-.\\s0-9])') THEN '{w}'" for w in terms.TIME_WORDS) \
    + " WHEN regexp_matches(s, 't[0-9]+') THEN 't' || regexp_extract(s, 't([0-9]+)', 1) ELSE 'unknown' END"
TOKENS = f""", tk AS (SELECT gse_id, pos, s, coalesce(nullif(regexp_extract(s, '^([a-z]+)([0-9]+)$', 1), ''), s) AS t0,
 coalesce(nullif(regexp_extract(s, '^([^_\\-. ]+)[_\\-. ]', 1), ''), s) AS t1, {TIME} AS t2, regexp_matches(s, '^[^_\\-. ]+[_\\-. ]')::INT AS sp FROM (SELECT gse_id, pos,
 lower(trim(title)) AS s FROM samples)), st AS (SELECT gse_id, pos, sp, 0 AS strategy, t0 AS token FROM tk UNION ALL SELECT gse_id, pos, sp, 1, t1 FROM tk UNION ALL SELECT gse_id, pos,
 sp, 2, t2 FROM tk), ct AS (SELECT gse_id, strategy, token, count(*) AS n, sum(sp)::BIGINT AS n_split, min(pos) AS pos FROM st GROUP BY ALL) """


@query("d9_group_counts", TOKENS + "SELECT gse_id, strategy, token, n FROM ct", "samples")
def d9(spark, sf):
    return sg.token_counts(table(spark, sf, "samples")).select("gse_id", "strategy", "token", "n")


@query("d10_merge_groups", "SELECT gse_id, CASE kind WHEN 'control group' THEN 'control' ELSE 'case' END AS root, count(*) AS n FROM samples GROUP BY ALL", "samples")
def d10(spark, sf):
    counts = table(spark, sf, "samples").groupBy("gse_id", c("kind").alias("name")).agg(F.count(lit(1)).alias("n"))
    return sg.merge_groups(counts)


@query("d11_cache_stats", "SELECT count(*) AS total, count(*) FILTER (cached_at >= TIMESTAMP '1999-12-31') AS valid, count(*) FILTER (cached_at < TIMESTAMP '1999-12-31') AS expired, "
       "sum(bytes)::BIGINT AS bytes FROM cache_index", "cache_index")
def d11(spark, sf):
    return a.cache_stats(table(spark, sf, "cache_index"), datetime(2000, 1, 1), 24)


@query("d12_check_stats", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (availability_status = '{s}') AS {s}" for s in (
    "available", "unavailable", "restricted", "unverified")) + " FROM datasets", "datasets")
def d12(spark, sf):
    return a.check_stats(table(spark, sf, "datasets"))


_VD, _VS = any_("x", terms.VERDICT_DISEASE_TERMS), any_("x", terms.VERDICT_SINGLE_CELL_TERMS)


@query("d13_verdicts", f"SELECT CASE WHEN {_VD} AND {_VS} THEN 'RELEVANT' WHEN {_VD} THEN 'PARTIAL' WHEN {_VS} THEN 'NOISE' ELSE 'GARBAGE' END AS verdict, count(*) AS n FROM (SELECT lower("
       "concat_ws(' ', title, abstract)) AS x FROM datasets) GROUP BY 1", "datasets")
def d13(spark, sf):
    return evaluate(table(spark, sf, "datasets"))


@query("d14_overview", "SELECT 'datasets' AS what, count(*) AS n FROM datasets UNION ALL SELECT 'topics', count(DISTINCT topic_id) FROM topic_datasets", "datasets topic_datasets")
def d14(spark, sf):
    return a.overview(table(spark, sf, "datasets"), topics(spark, sf))


@query("d15_vocabulary_audit", "SELECT 'several vocabularies' AS issue, '*' AS domain, lower(name) AS name FROM parts WHERE p_partkey % 2 = 0 UNION ALL SELECT 'key differs', 'assay', 'K' || name FROM "
       "parts WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT 'missing parent', 'assay', parent FROM parts WHERE parent <> '' AND p_partkey % 2 = 0", "parts")
def d15(spark, sf):
    organs = part_entries(spark, sf)
    other = organs.filter(F.regexp_extract("key", "([0-9]+)", 1).cast("long") % 2 == 0).withColumns(
        {"domain": lit("assay"), "key": F.concat(lit("K"), "key")})
    both = organs.unionByName(other)
    return a.vocabulary_audit(both, v.vocab_edges(both))
