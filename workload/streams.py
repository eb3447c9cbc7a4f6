"""Streams X1-X5 over the given event and document files, run until they are used up."""

from datetime import datetime

from pyspark.sql import functions as F

from lodecat.operators.review import review_state
from lodecat.operators.store import expire
from lodecat.session import run_folder
from lodecat.streaming import jobs, merge, state
from workload.derived import TABLES, table
from workload.registry import query

c, lit = F.col, F.lit


def stream(spark, sf, name):
    """The derived table as a stream of the given file, or of the files of the given folder."""
    source, columns = TABLES[name]
    schema = spark.read.parquet(f"{sf}/{source}.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/{source}.parque[t]")  # only a pattern may name a file
    return raw.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


UPSERTED = """, v AS (SELECT concat('K', CAST(doc_id % 300 AS VARCHAR)) AS gse_id, doc_id AS arrival, CASE WHEN doc_id % 7 = 0 THEN '' ELSE title END AS title, abstract, sample_count, availability_status
 FROM datasets WHERE doc_id % 50 <> 49) SELECT gse_id, coalesce(arg_max(title, arrival) FILTER (title <> ''), '') AS title, max(length(abstract)) AS n_abstract, coalesce(arg_max(sample_count, arrival) FILTER (sample_count > 0), 0) AS
 sample_count, arg_max(availability_status, arrival) AS availability_status FROM v GROUP BY gse_id"""


@query("x1_stream_upsert", UPSERTED, "datasets")
def x1(spark, sf):
    folder = run_folder(spark, "upsert")
    rows = arrivals(stream(spark, sf, "datasets"))
    jobs.stream_upsert(rows, folder + "/table", folder + "/state", every=None).awaitTermination()
    return jobs.read_table(spark, folder + "/table").select("gse_id", "title", F.length("abstract").alias("n_abstract"), "sample_count", "availability_status")


def arrivals(datasets):
    """Three hundred keys, and every fiftieth row without one."""
    return datasets.select(
        F.when(c("doc_id") % 50 == 49, "").otherwise(F.concat(lit("K"), (c("doc_id") % 300).cast("string"))).alias("gse_id"), c("doc_id").alias("arrival"),
        F.when(c("doc_id") % 7 == 0, "").otherwise(c("title")).alias("title"), "abstract", "sample_count", "availability_status")


@query("x1_stream_merge", UPSERTED, "datasets")
def x1b(spark, sf):
    """Four batches; each rewrites the buckets it touches, and readers fold nothing."""
    folder = run_folder(spark, "merge")
    rows = arrivals(table(spark, sf, "datasets"))
    last = rows.agg(F.max("arrival")).first()[0]
    for i in range(4):
        rows.filter((c("arrival") * 4 > lit(last) * i) & (c("arrival") * 4 <= lit(last) * (i + 1)) if i else c("arrival") * 4 <= lit(last)).coalesce(1).write.parquet(f"{folder}/in/n={i}")
    parts = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in/n=*")
    merge.stream_merge(parts, folder + "/table", folder + "/state", buckets=16, every=None).awaitTermination()
    return merge.read_merged(spark, folder + "/table").select("gse_id", "title", F.length("abstract").alias("n_abstract"), "sample_count", "availability_status")


STACK = """, e AS (SELECT topic_id, gse_id, acted_at, log_id, new_status, action, sum(CASE WHEN action = 'undo' THEN 1 ELSE -1 END) OVER (PARTITION BY topic_id, gse_id ORDER BY acted_at DESC, log_id DESC ROWS UNBOUNDED PRECEDING) AS
 suffix FROM review_log), top AS (SELECT topic_id, gse_id, arg_max(new_status, (acted_at, log_id)) AS status FROM e WHERE suffix = -1 AND action <> 'undo' GROUP BY ALL) SELECT topic_id, gse_id, coalesce(status, 'pending') AS status FROM
 (SELECT DISTINCT topic_id, gse_id FROM review_log) LEFT JOIN top USING (topic_id, gse_id)"""


@query("x2_review_state", STACK, "review_log")
def x2(spark, sf):
    return review_state(table(spark, sf, "review_log"))


@query("x2_review_stream", STACK, "review_log")
def x2b(spark, sf):
    folder = run_folder(spark, "review")
    jobs.stream_review(stream(spark, sf, "review_log"), folder + "/out", folder + "/state", every=None).awaitTermination()
    return jobs.read_status(spark, folder + "/out")


@query("x3_expire", "SELECT key FROM cache_index WHERE cached_at >= TIMESTAMP '1998-12-25 00:00:00'", "cache_index")
def x3(spark, sf):
    return expire(table(spark, sf, "cache_index"), "cached_at", 168, datetime(1999, 1, 1)).select("key")


@query("x2_review_keyed", STACK, "review_log")
def x2c(spark, sf):
    """Five batches; the actions of a pair come in any order, so most of them late."""
    folder = run_folder(spark, "review")
    log = table(spark, sf, "review_log")
    log.withColumn("part", c("log_id") * 7919 % 5).repartition("part").write.partitionBy("part").parquet(folder + "/in")
    parts = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder + "/in")
    state.keep_review(parts, folder + "/out", folder + "/state", "30 days", None).awaitTermination()
    return state.read_review(spark, folder + "/out")


@query("x3_expire_stream", "SELECT key, cached_at < (SELECT max(cached_at) FROM cache_index) - INTERVAL 336 HOURS AS expired FROM cache_index", "cache_index")
def x3b(spark, sf):
    """Five batches in the order of time: every key comes, and all but the newest leave again."""
    folder = run_folder(spark, "expiry")
    index = table(spark, sf, "cache_index").select("key", c("cached_at").cast("timestamp").alias("cached_at"))
    year = F.year("cached_at")
    for i, (low, high) in enumerate([(0, 1994), (1994, 1995), (1995, 1996), (1996, 1997), (1997, 9999)]):
        index.filter((year >= low) & (year < high)).coalesce(1).write.parquet(f"{folder}/in/n={i}")
    parts = spark.readStream.schema(index.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in/n=*")
    state.keep_unexpired(parts, "key", "cached_at", 336, folder + "/out", folder + "/state", None).awaitTermination()
    return state.read_keys(spark, folder + "/out").select("key", "expired")


@query("x4_history_counts", "SELECT topic_id, count(*) AS searches, sum(edge_id % 10)::BIGINT AS results FROM topic_datasets GROUP BY topic_id", "topic_datasets")
def x4(spark, sf):
    folder = run_folder(spark, "history")
    rows = stream(spark, sf, "topic_datasets").select("topic_id", c("added_at").alias("search_time"), (c("edge_id") % 10).alias("results_count"))
    jobs.run_once(jobs.history_counts(rows), folder + "/out", folder + "/state", "update")
    out = spark.read.parquet(folder + "/out")
    return out.groupBy("topic_id").agg(F.max_by(F.struct("searches", "results"), "batch").alias("l")).select("topic_id", "l.*")


@query("x5_stream_dedup", "SELECT topic_id, gse_id, count(*) AS n FROM (SELECT DISTINCT topic_id, gse_id FROM topic_datasets) GROUP BY ALL", "topic_datasets")
def x5(spark, sf):
    folder = run_folder(spark, "dedup")
    rows = stream(spark, sf, "topic_datasets").select("topic_id", "gse_id", c("added_at").cast("timestamp").alias("added_at"))
    jobs.run_once(jobs.stream_dedup(rows, ["topic_id", "gse_id"], "added_at", "60 days"), folder + "/out", folder + "/state")
    return spark.read.parquet(folder + "/out").groupBy("topic_id", "gse_id").agg(F.count(lit(1)).alias("n"))
