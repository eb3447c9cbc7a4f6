"""Streams whose past lies in keyed state, so that a batch costs what it brings.

State is kept by ``applyInPandasWithState``: it travels with the rows, needs no server beside
the Python worker, and is stored with the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from lodecat.operators.order import global_positions

PAIR = ["topic_id", "gse_id"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNTIMED = -(1 << 62)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk instead of in the executor's memory."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ON_DISK)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _run(out: DataFrame, folder: str, checkpoint: str, every: str | None) -> StreamingQuery:
    """Changes of each batch under its number; a repeated batch overwrites itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    with state_on_disk(out.sparkSession):
        return (out.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())


# --- reviews ------------------------------------------------------------------------------

def reduce_actions(actions: Iterable[tuple[bool, str]]) -> tuple[int, list[str]]:
    """A run of actions as (undos left over, statuses that stand).

    Two neighbouring runs join by letting the undos of the later take statuses of the earlier.
    """
    pops, stands = 0, []
    for undo, status in actions:
        if not undo:
            stands.append(status)
        elif stands:
            stands.pop()
        else:
            pops += 1
    return pops, stands


def _keep_actions(key: tuple, frames: Iterator[pd.DataFrame],
                  state: GroupState) -> Iterator[pd.DataFrame]:
    actions = list(zip(*state.get, strict=True)) if state.exists else []
    for f in frames:
        actions += zip(f["at"].tolist(), f["log_id"].tolist(), f["undo"].tolist(),
                       f["new_status"].tolist(), strict=True)
    actions.sort(key=lambda a: (a[0], a[1], a[3] or ""))
    state.update(tuple(list(column) for column in zip(*actions, strict=True)))
    pops, stands = reduce_actions((undo, status) for _, _, undo, status in actions)
    yield pd.DataFrame({"topic_id": [key[0]], "gse_id": [key[1]], "span": [key[2]],
                        "pops": [pops], "stands": [stands]})


def review_spans(log: DataFrame, span: str = "1 day") -> DataFrame:
    """(topic_id, gse_id, span, pops, stands) of every pair and time span a batch touched.

    ``log`` has topic_id, gse_id, action, new_status, acted_at and log_id, and comes in any
    order.  State is keyed by the pair and a span of time, so the actions of one pair spread
    over tasks, a late action changes its own span alone, and nothing is ever too late.  A
    span's own actions stay in one task: choose ``span`` by the busiest pair.  Actions
    without a time come before all others, those without an id first of their time.  Rows that are repeated count as often as they come.
    """
    kind, low = (("string", "") if isinstance(log.schema["log_id"].dataType, StringType)
                 else ("long", UNTIMED))
    width = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {span})")
    at = F.coalesce(F.unix_micros(F.col("acted_at").cast("timestamp")), F.lit(UNTIMED))
    rows = log.select(
        *[F.col(p).cast("string").alias(p) for p in PAIR], F.floor(at / width).cast("long").alias("span"),
        at.alias("at"), F.coalesce(F.col("log_id").cast(kind), F.lit(low)).alias("log_id"),
        F.coalesce(F.col("action") == "undo", F.lit(False)).alias("undo"), "new_status")
    return rows.groupBy(*PAIR, "span").applyInPandasWithState(
        _keep_actions, "topic_id string, gse_id string, span long, pops long, stands array<string>",
        f"at array<long>, log_id array<{kind}>, undo array<boolean>, new_status array<string>",
        "update", GroupStateTimeout.NoTimeout)


def keep_review(log: DataFrame, folder: str, checkpoint: str, span: str = "1 day",
                every: str | None = "2 seconds") -> StreamingQuery:
    """Runs :func:`review_spans`; :func:`read_review` gives the status of every pair."""
    return _run(review_spans(log, span), folder, checkpoint, every)


def read_review(spark: SparkSession, folder: str) -> DataFrame:
    """(topic_id, gse_id, status): the latest action that no undo took, else pending.

    Each span counts as its last batch left it.  From the end of a pair, ``need`` undos come
    into a span; the first span with more standing statuses than that holds the answer.  The
    sums run over one total order of narrow rows, so a pair of very many spans spreads too.
    """
    latest = spark.read.parquet(folder).groupBy(*PAIR, "span").agg(
        F.max_by(F.struct("pops", "stands"), F.col("batch").cast("long")).alias("s")).select(
        *PAIR, "span", "s.pops", "s.stands")
    narrow = latest.select(*PAIR, "span", "pops", F.size("stands").cast("long").alias("n"))
    placed = global_positions(narrow, [F.col(k) for k in (*PAIR, "span")], "_at",
                              {"_through": F.col("n") - F.col("pops")})
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    ends = placed.groupBy(*PAIR).agg(F.max_by("_through", "_at").alias("_end"))
    need = F.col("_through") - F.col("_end")
    chosen = (placed.alias("p").join(ends.alias("e"), same("p", "e", PAIR))
              .filter(F.col("n") > need).groupBy("p.topic_id", "p.gse_id")
              .agg(F.max_by(F.struct("span", (F.col("n") - need).alias("place")), "span").alias("c"))
              .select(*PAIR, "c.*"))
    found = (chosen.alias("c").join(latest.alias("l"), same("c", "l", [*PAIR, "span"]))
             .select("c.topic_id", "c.gse_id",
                     F.element_at("stands", F.col("place").cast("int")).alias("status"),
                     F.lit(True).alias("stood")))
    return (ends.alias("e").join(found.alias("f"), same("e", "f", PAIR), "left")
            .select("e.topic_id", "e.gse_id",
                    F.when(F.col("stood"), F.col("status")).otherwise("pending").alias("status")))


# --- expiry -------------------------------------------------------------------------------

def _keep_newest(bucket: tuple, frames: Iterator[pd.DataFrame],
                 state: GroupState) -> Iterator[pd.DataFrame]:
    clock = state.getCurrentWatermarkMs()
    held = {k: (at, ever) for k, at, ever in zip(*state.get, strict=True)} if state.exists else {}
    came = {}
    for f in frames if not state.hasTimedOut else ():
        for k, at, ever in zip(f["key"].tolist(), f["at_ms"].tolist(), f["untimed"].tolist(), strict=True):
            newest, forever = came.get(k) or held.get(k) or (UNTIMED, False)
            came[k] = (max(newest, at), forever or ever)
    came = {k: v for k, v in came.items() if k in held or v[1] or v[0] >= clock}
    gone = {k: v for k, v in held.items() if k not in came and not v[1] and v[0] < clock}
    held = {k: v for k, v in held.items() if k not in gone} | came
    if held:
        state.update((list(held), [at for at, _ in held.values()], [ever for _, ever in held.values()]))
        first = min((at for at, ever in held.values() if not ever), default=None)
        if first is not None:
            state.setTimeoutTimestamp(max(first, clock + 1, 1))
    elif state.exists:
        state.remove()
    for rows, expired in ((gone, True), (came, False)):
        if rows:
            yield pd.DataFrame({"key": list(rows), "at_ms": [at for at, _ in rows.values()], "expired": expired})


def expiring_keys(stream: DataFrame, key: str, time: str, ttl_hours: float, buckets: int = 1024) -> DataFrame:
    """(key, at_ms, expired): keys as they come, and each once more as a deletion when its
    newest row is older than the time to live (X3).

    The clock is the greatest time seen so far.  State is kept by buckets of keys, by a hash, so that a
    call serves many keys at once; a bucket's timer fires when the clock passes the first of its keys,
    also when none of them sends rows.  A batch rewrites the buckets it touches: choose ``buckets`` so that
    one holds some thousand keys.  The watermark lies one time to live behind the clock, so the rows it
    turns away are those that were dead on arrival; they are not named at all.  A deletion follows at
    most two milliseconds late.  A key that ever came without a time never expires.
    """
    at = F.col(time).cast("timestamp")
    rows = stream.select(
        F.col(key).cast("string").alias("key"), F.coalesce(F.unix_millis(at), F.lit(UNTIMED)).alias("at_ms"),
        at.isNull().alias("untimed"), at.alias("_time")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return (rows.withWatermark("_time", f"{round(ttl_hours * 3600)} seconds")
            .groupBy("bucket").applyInPandasWithState(
                _keep_newest, "key string, at_ms long, expired boolean",
                "keys array<string>, newest array<long>, forever array<boolean>", "update", GroupStateTimeout.EventTimeTimeout))


def keep_unexpired(stream: DataFrame, key: str, time: str, ttl_hours: float, folder: str,
                   checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Runs :func:`expiring_keys`; :func:`read_keys` gives the last word on every key."""
    return _run(expiring_keys(stream, key, time, ttl_hours), folder, checkpoint, every)


def read_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key, at_ms, expired) as the last batch that named the key left it."""
    return spark.read.parquet(folder).groupBy("key").agg(F.max_by(
        F.struct("at_ms", "expired"), F.col("batch").cast("long")).alias("s")).select("key", "s.*")
