"""Findings of the third review, on tables that show them."""

from pathlib import Path

import pytest

import workload
from tools.check import NAMES, compare, connect

workload.load_all()
SF = "/root/testdata/sf0.001"


def tables(spark, folder, **changed):
    """The smallest tables, some of them replaced."""
    for name in NAMES:
        if name in changed:
            changed[name].write.parquet(f"{folder}/{name}.parquet")
        else:
            Path(folder, f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(folder)


def verdict(spark, sf, name):
    con = connect(SF)
    for n in NAMES:
        path = Path(sf, f"{n}.parquet")
        if path.is_dir():
            con.execute(f"CREATE OR REPLACE VIEW {n} AS SELECT * FROM '{path}/*.parquet'")
    return compare(spark, con, sf, name, workload.QUERIES[name], workload.ORACLES[name])


@pytest.mark.parametrize("name", ["c3_infer", "c3_infer_large"])
def test_records_without_samples_are_kept(spark, tmp_path, name):
    few = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey % 1000 < 40")
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert verdict(spark, tables(spark, tmp_path, lineitem=few), name).startswith(f"ok {docs} ")


def test_landed_packages_take_little_disk(spark):
    from pyspark.sql import functions as F
    from workload import readers, sources
    packages = sources.xml_packages(spark, SF)
    folder = readers.files(spark, packages)
    stored = sum(p.stat().st_size for p in Path(folder).iterdir())
    assert stored * 5 < packages.agg(F.sum(F.octet_length("body"))).first()[0]


@pytest.mark.parametrize("name", ["x1_stream_upsert", "x4_history_counts"])
def test_streams_read_tables_of_several_files(spark, tmp_path, name):
    parts = {t: spark.read.parquet(f"{SF}/{t}.parquet").repartition(3) for t in ("documents", "events")}
    assert verdict(spark, tables(spark, tmp_path, **parts), name).startswith("ok ")


def test_expiry_calls_serve_many_keys(spark, tmp_path):
    from datetime import datetime, timedelta
    from lodecat.streaming import state
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    for i, low in enumerate((0, 10, 20, 30)):  # each batch ends the keys of the last one; null and repeated keys too
        rows = [(f"k{low}-{n}", day(low)) for n in range(1500)] + [(None, day(low)), ("again", day(low)), ("again", day(low))]
        spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/n={i}")
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/n=*")
    kept = state.keep_unexpired(stream, "k", "t", 96, f"{tmp_path}/out", f"{tmp_path}/state", None)
    kept.awaitTermination()
    held = [o["numRowsTotal"] for p in kept.recentProgress for o in p["stateOperators"]]
    assert max(held) <= 1024  # state rows are buckets, not keys
    last = {r.key: r.expired for r in state.read_keys(spark, f"{tmp_path}/out").collect()}
    assert len(last) == 6002 and last[None] is False and last["again"] is False
    assert all(gone == (k is not None and not k.startswith(("k30", "again"))) for k, gone in last.items())
    told = spark.read.parquet(f"{tmp_path}/out").filter("expired").groupBy("key").count()
    assert told.filter("count > 1 and key <> 'again' and key is not null").count() == 0


def shuffled(df):
    """Bytes that a query's exchanges write."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            plan.append(p.plan())
        if p.metrics().contains("shuffleBytesWritten"):
            found += p.metrics().apply("shuffleBytesWritten").value()
        kids = p.children()
        plan += [kids.apply(k) for k in range(kids.size())]
    return found


def test_places_of_terms_carry_no_surroundings(spark):
    import random
    from pyspark.sql import functions as F
    from lodecat.operators import anchored
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(60)]
    terms = spark.createDataFrame([(w,) for w in words] + [(f"{a} {b} {a}",) for a, b in zip(words, words[1:])], "term string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(anchored.word_hits(df, "id", F.col("t"), terms))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < moved < 3 * sum(map(len, texts))


def test_substrings_carry_no_surroundings(spark):
    import random
    from pyspark.sql import functions as F
    from lodecat.operators import anchored
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice((3, 9, 14)))) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = anchored.substring_hits(df, "id", F.col("t"), spark.createDataFrame([(w,) for w in words], "term string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(x) for x in found.collect()} == {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    assert 0 < moved < 6 * sum(map(len, texts))


def test_the_set_of_terms_grows_with_them(spark, monkeypatch):
    from lodecat.operators import anchored
    monkeypatch.setattr(anchored, "BITS", 1 << 10)
    units = spark.range(20_000).selectExpr("cast(id as string) AS unit")
    rows = spark.range(40_000).selectExpr("cast(id as string) AS u")
    kept = anchored.keep_known(rows, "u", units, "unit")
    assert kept.columns == ["u"] and kept.join(units, kept.u == units.unit).count() == 20_000
    assert kept.count() < 24_000  # a set of fixed size lets all 40,000 through


def test_pieces_stay_small_as_inputs_grow(spark, monkeypatch):
    from lodecat import session
    monkeypatch.setattr(session, "PIECE_BYTES", 10_000, raising=False)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert session.spread(rows).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
