"""First-of, top-n, ranks and running sums W1-W8; sorts and pages T1-T7."""

from pyspark.sql import functions as F

from lodecat.functions import score
from lodecat.operators import order as o
from lodecat.operators.filters import review_log
from lodecat.operators.review import latest_entry
from lodecat.operators.store import query_hash
from lodecat.plans import ranking
from lodecat.plans.search import deduplicate
from lodecat.plans.topics import generate_keywords
from workload.derived import table
from workload.filters import VIEW_CTE, view
from workload.joins import _DIM, topic_dimensions, topics
from workload.registry import query
from workload.scalars import species_sql
from workload.text import knowledge
from lodecat.fixed import terms

c, lit = F.col, F.lit


@query("w1_deduplicate", "SELECT gse_id, arg_min(edge_id, (CASE match_source WHEN 'geo' THEN 0 WHEN 'sra' THEN 1 ELSE 2 END, edge_id)) AS edge_id FROM topic_datasets GROUP BY 1", "topic_datasets")
def w1(spark, sf):
    rank = F.when(c("match_source") == "geo", 0).when(c("match_source") == "sra", 1).otherwise(2)
    rows = table(spark, sf, "topic_datasets").withColumns({"source_rank": rank, "pos": c("edge_id")})
    return deduplicate(rows).select("gse_id", "edge_id")


@query("w2_latest_entry", "SELECT topic_id, gse_id, arg_max(log_id, (acted_at, log_id)) AS log_id, arg_max(action, (acted_at, log_id)) AS action FROM review_log GROUP BY ALL", "review_log")
def w2(spark, sf):
    return latest_entry(table(spark, sf, "review_log")).select("topic_id", "gse_id", "log_id", "action")


@query("w3_rank", "SELECT edge_id, row_number() OVER (ORDER BY match_score DESC, edge_id) AS rank FROM topic_datasets", "topic_datasets")
def w3(spark, sf):
    return o.global_positions(table(spark, sf, "topic_datasets"), [c("match_score").desc(), c("edge_id")]).select("edge_id", "rank")


@query("w4_evict", """, t AS (SELECT count(*) AS n, sum(bytes) AS b FROM cache_index), o AS (SELECT key, bytes, row_number() OVER w AS r, sum(bytes) OVER w AS through FROM cache_index WINDOW w AS
 (ORDER BY cached_at, key ROWS UNBOUNDED PRECEDING)) SELECT key FROM o, t WHERE (n > 500 OR b > 1e9) AND (n - (r - 1) > 490 OR b - (through - bytes) > 0.8e9)""", "cache_index")
def w4(spark, sf):
    return o.evict(table(spark, sf, "cache_index"), 500, 10**9).select("key")


@query("w5_latest_report", "SELECT query_hash, mode, sources, max(searched_at) AS searched_at FROM (SELECT left(sha256(match_keyword), 16) AS query_hash, topic_id AS mode, match_source AS sources, "
       "added_at AS searched_at FROM topic_datasets) GROUP BY ALL", "topic_datasets")
def w5(spark, sf):
    rows = table(spark, sf, "topic_datasets").select(
        query_hash(c("match_keyword")).alias("query_hash"), c("topic_id").alias("mode"), c("match_source").alias("sources"),
        c("added_at").alias("searched_at"), "edge_id")
    return o.first_per_key(rows, ["query_hash", "mode", "sources"], [c("searched_at"), c("edge_id")], last=True).drop("edge_id")


@query("w6_first_n_per_key", "SELECT pmid, gse_id, rank FROM (SELECT pmid, gse_id, row_number() OVER (PARTITION BY pmid ORDER BY gse_id) AS rank FROM (SELECT DISTINCT * FROM paper_links)) WHERE rank "
       "<= 5", "paper_links")
def w6(spark, sf):
    return o.top_per_key(table(spark, sf, "paper_links").distinct(), ["pmid"], [c("gse_id")], 5)


@query("w7_to_score", "SELECT gse_id, sample_count >= 600 AND row_number() OVER (ORDER BY CASE WHEN sample_count >= 600 THEN 0 ELSE 1 END, sample_count DESC, gse_id) <= 20 AS to_score FROM (SELECT "
       "* FROM datasets ORDER BY sample_count DESC, gse_id LIMIT 150)", "datasets")
def w7(spark, sf):
    df = table(spark, sf, "datasets").withColumns({"total_score": c("sample_count"), "relevance_score": c("sample_count")})
    return ranking.to_score(ranking.best_first(df, "total_score", 150), 20, 600).select("gse_id", "to_score")


_SNAP = """, s AS (SELECT gse_id, log_id, acted_at AS taken_at, md5(new_status) AS h FROM review_log), g AS (SELECT *, lag(h) OVER (PARTITION BY gse_id ORDER BY taken_at, log_id) AS ph FROM s)
 SELECT gse_id, CAST(min(taken_at) AS VARCHAR)[1:19] AS first_seen, CAST(max(taken_at) AS VARCHAR)[1:19] AS last_seen, 1 + count(*) FILTER (ph IS NOT NULL AND ph <> h) AS version, count(*) AS
 snapshots FROM g GROUP BY gse_id"""


@query("w8_seen_and_version", _SNAP, "review_log")
def w8(spark, sf):
    rows = table(spark, sf, "review_log").select("gse_id", c("acted_at").alias("taken_at"), F.md5("new_status").alias("metadata_hash"))
    out = o.seen_and_version(rows)
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return out.select("gse_id", stamp("first_seen_at").alias("first_seen"), stamp("last_updated").alias("last_seen"), "version", "snapshots")


# --- sorts ---------------------------------------------------------------------------------

TOTAL = ("(0.4 * relevance + 0.2 * recency + 0.2 * quality + 0.2 * CASE WHEN sample_count > 0 THEN least(sample_count / 1000.0, 1) ELSE 0 END) * "
         + species_sql("organism", terms.SPECIES_WEIGHTS_SHORT))


@query("t1_weighted_top", VIEW_CTE + f"SELECT gse_id, round(({TOTAL})::DOUBLE, 5) AS total_score FROM viewed ORDER BY round(({TOTAL})::DOUBLE, 9) DESC, gse_id LIMIT 50", "datasets")
def t1(spark, sf):
    scored = view(spark, sf).withColumn("total_score", F.round(score.total(
        score.Weights(), c("organism"), c("sample_count"), F.round("relevance_score", 6), c("recency_score"), c("quality_score")), 9))
    return ranking.best_first(scored, "total_score", 50).select("gse_id", F.round("total_score", 5).alias("total_score"))


@query("t2_overfetch", "SELECT gse_id FROM (SELECT * FROM datasets ORDER BY sample_count DESC, gse_id LIMIT 60) ORDER BY n_chars DESC, gse_id LIMIT 20", "datasets")
def t2(spark, sf):
    page = ranking.best_first(table(spark, sf, "datasets"), "sample_count", 60)
    return ranking.best_first(page, "n_chars", 20).select("gse_id")


@query("t3_match_score_sort", "SELECT edge_id, match_score FROM topic_datasets", "topic_datasets")
def t3(spark, sf):
    return ranking.best_first(table(spark, sf, "topic_datasets"), "match_score", None, "edge_id").select("edge_id", "match_score")


@query("t4_ranker_sort", "SELECT edge_id, match_score FROM topic_datasets ORDER BY match_score DESC, edge_id LIMIT 500", "topic_datasets")
def t4(spark, sf):
    return ranking.best_first(table(spark, sf, "topic_datasets"), "match_score", 500, "edge_id").select("edge_id", "match_score")


@query("t5_page", "SELECT gse_id, last_updated FROM datasets ORDER BY last_updated DESC, gse_id LIMIT 25 OFFSET 50", "datasets")
def t5(spark, sf):
    from lodecat.operators.filters import list_datasets
    return list_datasets(table(spark, sf, "datasets"), limit=25, offset=50).select("gse_id", "last_updated")


@query("t6_best_keywords", _DIM + ", r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(weight, 9) DESC, seq) AS rank FROM u WHERE first = 1) SELECT topic_id, keyword, rank FROM r WHERE "
       "rank <= 4", "datasets")
def t6(spark, sf):
    return generate_keywords(topic_dimensions(spark, sf), knowledge(spark), 4).select("topic_id", "keyword", "rank")


@query("t7_topics_and_log", "SELECT 'topic' AS what, topic_id AS id FROM (SELECT topic_id, max(added_at) AS t FROM topic_datasets GROUP BY 1 ORDER BY t DESC LIMIT 7) UNION ALL SELECT 'log', CAST(log_id AS "
       "VARCHAR) FROM (SELECT * FROM review_log ORDER BY acted_at DESC, log_id DESC LIMIT 20)", "topic_datasets review_log")
def t7(spark, sf):
    newest = topics(spark, sf).orderBy(c("last_searched_at").desc(), "topic_id").limit(7)
    return newest.select(lit("topic").alias("what"), c("topic_id").alias("id")).unionByName(
        review_log(table(spark, sf, "review_log")).select(lit("log").alias("what"), c("log_id").cast("string").alias("id")))
