"""A table merged by touched buckets: same rows as one fold, small writes, repeats, bad rows."""

import random

from pyspark.sql import functions as F

from lodecat.operators import store
from lodecat.session import run_folder
from lodecat.streaming import merge

SCHEMA = "gse_id string, title string, abstract string, sample_count int, arrival long, attributes map<string,string>"


def rows(df):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect()), key=repr)


def make(seed, n, keys):
    rng = random.Random(seed)
    return [(f"G{rng.randrange(keys)}" if i % 25 else rng.choice(["", None]), rng.choice(["", f"t{i}"]), "a" * rng.randrange(9), rng.randrange(3), i,
             rng.choice([{}, {"k": str(i)}, None])) for i in range(n)]


def test_stream_equals_one_fold(spark):
    data = make(3, 500, 40)
    folder = run_folder(spark, "t")
    for i in range(4):
        spark.createDataFrame(data[i * 125:(i + 1) * 125], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/n={i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/n=*")
    merge.stream_merge(stream, folder + "/table", folder + "/state", buckets=8, every=None).awaitTermination()
    got = merge.read_merged(spark, folder + "/table")
    want = store.fold_versions(spark.createDataFrame(data, SCHEMA).filter("gse_id <> ''"), "gse_id", "arrival")
    assert rows(got.select(want.columns)) == rows(want)
    assert spark.read.parquet(folder + "/table/rejected").count() == 20


def test_a_batch_writes_the_buckets_it_touches(spark):
    folder = run_folder(spark, "t")
    first = spark.range(4000).select(F.concat(F.lit("G"), "id").alias("gse_id"), F.lit("t").alias("title"), F.col("id").alias("arrival"))
    late = spark.createDataFrame([("G7", "new", 0), ("G9", "", 1), ("", "lost", 2)], "gse_id string, title string, arrival long")
    merge.merge_batch(first, 0, folder, buckets=100)
    merge.merge_batch(late, 1, folder, buckets=100)
    written = spark.read.parquet(folder + "/buckets").groupBy("batch").agg(F.count_distinct("bucket").alias("b"), F.count("*").alias("n"))
    by = {r.batch: (r.b, r.n) for r in written.collect()}
    assert by[0] == (100, 4000) and by[1][0] == 2 and by[1][1] < 200
    got = {r.gse_id: r.title for r in merge.read_merged(spark, folder).filter("gse_id in ('G7', 'G9', 'G11')").collect()}
    assert got == {"G7": "new", "G9": "t", "G11": "t"} and merge.read_merged(spark, folder).count() == 4000
    once = rows(merge.read_merged(spark, folder))
    merge.merge_batch(late, 1, folder, buckets=100)  # the same batch again
    assert rows(merge.read_merged(spark, folder)) == once
    merge.merge_batch(late.limit(0), 2, folder, buckets=100)
    assert rows(merge.read_merged(spark, folder)) == once


def test_columns_that_come_later(spark):
    folder = run_folder(spark, "t")
    merge.merge_batch(spark.createDataFrame([("a", "x", 1)], "gse_id string, title string, arrival long"), 0, folder, buckets=2)
    merge.merge_batch(spark.createDataFrame([("a", "lung", 1), ("b", "skin", 2)], "gse_id string, organ string, arrival long"), 1, folder, buckets=2)
    got = {r.gse_id: (r.title, r.organ) for r in merge.read_merged(spark, folder).collect()}
    assert got == {"a": ("x", "lung"), "b": (None, "skin")}
