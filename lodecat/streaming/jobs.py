"""The catalogue as streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodecat.operators.review import review_state
from lodecat.operators.store import fold_versions


def stream_upsert(stream: DataFrame, folder: str, checkpoint: str, key: str = "gse_id",
                  order: str = "arrival", every: str | None = "2 seconds") -> StreamingQuery:
    """Upserts of a stream into a table folder.

    A batch writes what changed, folded to one row per key, under its batch number; it never
    rewrites the table, so its cost follows the batch.  A repeated batch overwrites itself.
    Rows without a key go to ``rejected``.  :func:`read_table` folds the parts;
    :func:`compact` merges them.
    """
    def write(batch: DataFrame, number: int) -> None:
        good = F.coalesce(F.col(key), F.lit("")) != ""
        batch.filter(~good).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        folded = fold_versions(batch.filter(good), key, order)
        folded.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_table(spark: SparkSession, folder: str, key: str = "gse_id") -> DataFrame:
    """Current rows: all parts folded in batch order."""
    parts = spark.read.parquet(f"{folder}/parts").withColumn("batch", F.col("batch").cast("long"))
    return fold_versions(parts, key, "batch")


def compact(spark: SparkSession, folder: str, into: str, key: str = "gse_id") -> None:
    """One folded part in a new folder; readers switch when it is complete."""
    read_table(spark, folder, key).write.mode("overwrite").parquet(f"{into}/parts/batch=0")


def stream_review(log: DataFrame, folder: str, checkpoint: str,
                  every: str | None = "2 seconds", buckets: int = 32) -> StreamingQuery:
    """Review actions as a stream: the log, and the status of every pair a batch touched.

    Undo needs all earlier actions of a pair, in time order, also those that arrive late.  So
    a batch is first added to the stored log, which is laid out by a hash of the pair; then
    the touched pairs are folded from their buckets by :func:`review_state`, which spreads a
    pair with very many actions over tasks.  No state lives in one task, and a repeated batch
    overwrites itself.
    """
    pair = ["topic_id", "gse_id"]
    bucket = F.pmod(F.hash(*pair), F.lit(buckets))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        (batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket")
         .parquet(f"{folder}/log/batch={number}"))
        fresh = spark.read.schema(batch.schema).parquet(f"{folder}/log/batch={number}")
        hit = [r[0] for r in fresh.select(bucket).distinct().collect()]  # at most ``buckets``
        if not hit:
            return
        stored = spark.read.option("basePath", f"{folder}/log").parquet(f"{folder}/log")
        stored = stored.filter((F.col("batch") <= number) & F.col("bucket").isin(*hit))
        state = review_state(stored.drop("batch", "bucket").join(
            fresh.select(*pair).distinct(), pair, "left_semi"))
        state.write.mode("overwrite").parquet(f"{folder}/status/batch={number}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """Current status per pair: that of the last batch that touched it."""
    return spark.read.parquet(f"{folder}/status").groupBy("topic_id", "gse_id").agg(
        F.max_by("status", "batch").alias("status"))


def expire_stream(stream: DataFrame, time: str, ttl_hours: float,
                  as_of: datetime | None = None) -> DataFrame:
    """Rows not older than the time to live; rows without a time stay.

    Without ``as_of`` the clock of each micro-batch counts, so a running stream goes on expiring.
    """
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    ttl = F.make_dt_interval(secs=F.lit(ttl_hours * 3600).cast("decimal(18,6)"))
    return stream.filter(F.col(time).isNull() | (F.col(time) >= now - ttl))


def history_counts(history: DataFrame) -> DataFrame:
    """Searches and results per topic, kept up to date."""
    return history.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("searches"), F.sum("results_count").alias("results"),
        F.max("search_time").alias("last_search"))


def stream_dedup(stream: DataFrame, key: list[str], time: str, within: str) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def run_once(out: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """All input that is there now, into Parquet; each batch once."""
    if mode == "append":
        query = (out.writeStream.format("parquet").option("path", folder)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
                f"{folder}/n={number}")

        query = (out.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
