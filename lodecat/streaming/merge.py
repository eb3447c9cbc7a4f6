"""A stored table that a stream keeps merged: a batch rewrites the buckets it touches.

Rows lie in buckets by a hash of the key.  ``buckets/batch=N/bucket=B`` holds bucket B as
batch N left it, ``marks/batch=N`` names the buckets that batch N wrote, and is written last, so
that a batch is seen as a whole or not at all.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodecat.operators.store import fold_versions, upsert


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _current(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """The last batch that wrote each bucket: at most one row per bucket, a fixed number."""
    try:
        marks = spark.read.parquet(f"{folder}/marks")
    except AnalysisException:  # nothing written yet
        return {}
    batch = F.col("batch").cast("long")
    known = marks if before is None else marks.filter(batch < before)
    return {r["bucket"]: r["last"] for r in known.groupBy("bucket").agg(F.max(batch).alias("last")).collect()}


def _read(spark: SparkSession, folder: str, current: dict[int, int]) -> DataFrame:
    return (spark.read.option("basePath", f"{folder}/buckets").option("mergeSchema", True)
            .parquet(*[f"{folder}/buckets/batch={n}/bucket={b}" for b, n in sorted(current.items())])
            .drop("batch", "bucket"))


def merge_batch(batch: DataFrame, number: int, folder: str, key: str = "gse_id",
                order: str = "arrival", buckets: int = 256) -> None:
    """One batch into the table, folded by the rules of :func:`upsert`.

    Reads and writes the touched buckets alone.  A batch that comes again sees the table as it
    was before it and overwrites what it wrote.  Rows without a key go to ``rejected``.  An
    empty batch changes nothing.  Choose ``buckets`` so that a bucket is about a file: the rows
    of a bucket are written by one task, and as keys are unique in the table, no key is hot.
    """
    spark = batch.sparkSession
    good = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    batch.filter(~good).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
    staged = f"{folder}/incoming/batch={number}"
    at = bucket_of(key, buckets)
    (fold_versions(batch.filter(good), key, order).withColumn("bucket", at)
     .write.mode("overwrite").parquet(staged))
    fresh = spark.read.parquet(staged)
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    before = _current(spark, folder, number)
    old = {b: before[b] for b in touched if b in before}
    rows = fresh.drop("bucket").withColumn(order, F.lit(0).cast("long"))
    merged = upsert(_read(spark, folder, old), rows, key, order) if old else rows.drop(order)
    (merged.withColumn("bucket", at).repartition("bucket").write.mode("overwrite")
     .partitionBy("bucket").parquet(f"{folder}/buckets/batch={number}"))
    fresh.select("bucket").distinct().coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/marks/batch={number}")


def stream_merge(stream: DataFrame, folder: str, checkpoint: str, key: str = "gse_id",
                 order: str = "arrival", buckets: int = 256,
                 every: str | None = "2 seconds") -> StreamingQuery:
    """Upserts of a stream into a table that is merged at all times (X1); later batches count
    as later rows."""
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # rejected and good rows come from one reading of the source
        try:
            merge_batch(rows, number, folder, key, order, buckets)
        finally:
            rows.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows: the last version of every bucket, as it lies; nothing is folded."""
    current = _current(spark, folder)
    if not current:
        raise ValueError(f"no batch has been merged into {folder} yet")
    return _read(spark, folder, current)
