"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodecat", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partition counts are left to the cluster; AQE coalesces and splits them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where no folder is configured and all runs in one process (tests, a laptop) is a
    temporary one set; a cluster without the setting is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = known.get() if known.isDefined() else None
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors.

    Its shuffle files go when it is written: nothing reads them again, and else they stay until the
    driver happens to collect its garbage, so that a loop of many steps piles them up.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew: a plan takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Largest table that is broadcast, by the planner's estimate and by the size that shuffles measure.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that are run inside broadcast a table by its measured size alone.

    The estimate starts from the length of files, and names that are read out of packed files take many
    times that, in the driver too; a broadcast once planned is not taken back.
    """
    before = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    spark.conf.set(MEASURED, before[MEASURED] or spark.conf.get(ESTIMATED))
    spark.conf.set(ESTIMATED, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


SPLIT_BYTES = 128 * 1024 * 1024
PIECE_BYTES = 8 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input is too small to come in a piece per core.

    For work that costs far more per row than a shuffle of the row, such as reading XML or
    scanning whole texts.  Only the planner's size estimate is asked; no job runs.  Pieces are small, so
    that what a task holds, such as groups before a shuffle, does not grow with the input.  Inputs of
    a cluster's size stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    names = plan.toString()
    shuffled = any(step in names for step in ("Repartition", "Aggregate [", "Join "))
    size = int(str(plan.stats().sizeInBytes()))
    small = size < cores * SPLIT_BYTES
    return df.repartition(max(cores, -(-size // PIECE_BYTES))) if small and not shuffled else df
