"""Positions, picks and running sums over a total order.

Spark rows have no order of their own, so every function takes its order explicitly and
callers end it with a unique column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecat.session import cut_lineage

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def global_positions(df: DataFrame, order: Sequence[Column], rank: str = "rank",
                     sums: Mapping[str, Column] | None = None) -> DataFrame:
    """1-based rank, and running sums, over one total order of the whole table.

    A window without partitions would sort everything in one task.  Here rows are range
    partitioned by the order, numbered inside their range, and shifted by what precedes the
    range.  A hot key spreads over several ranges because the order ends in a unique column.
    """
    sums = dict(sums or {})
    ranged = (df.withColumns({f"_v_{n}": c for n, c in sums.items()})
              .repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_slot", F.monotonically_increasing_id()))
    fixed = cut_lineage(ranged).withColumns({
        "_part": F.shiftright("_slot", _INDEX_BITS),
        "_index": F.col("_slot").bitwiseAND((1 << _INDEX_BITS) - 1)})
    inside = Window.partitionBy("_part").orderBy("_index").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many rows as shuffle partitions, hence safe to window and broadcast.
    totals = fixed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    shift = totals.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    out = fixed.join(F.broadcast(shift), "_part").withColumn(
        rank, F.col("_before") + F.col("_index") + 1)
    for n in sums:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(inside) + F.col(f"_b_{n}"))
    return out.drop("_part", "_slot", "_index", "_before",
                    *[c for n in sums for c in (f"_v_{n}", f"_b_{n}")])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column,
                at_most: int | None = None, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key with their rank.

    Spark cuts every input partition to ``n`` rows per key before it shuffles, so a hot key
    sends little.  ``n`` may be a column when ``at_most`` gives its largest value.
    """
    over = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(over))
    if at_most is not None:
        numbered = numbered.filter(F.col(rank) <= at_most)
    return numbered.filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  last: bool = False) -> DataFrame:
    """The first (or last) row per key.

    An aggregate, not a window: each input partition sends one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    place = order[0] if len(order) == 1 else F.struct(
        *[c.alias(f"o{i}") for i, c in enumerate(order)])
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), place).alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))


def sortable(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as an order; one that holds a map goes by its JSON, as maps have no order."""
    return [F.to_json(F.struct(c)) if "map<" in df.schema[c].dataType.simpleString() else F.col(c) for c in columns]


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key, the last by ``order``; without one, the greatest by all other columns."""
    rest = sortable(df, [c for c in df.columns if c not in keys])
    if not rest:
        return df.distinct()
    return first_per_key(df, keys, [*(order or []), *rest], last=True)


def evict(index: DataFrame, max_entries: int, max_bytes: int, spare: int = 10,
          keep_share: float = 0.8) -> DataFrame:
    """Cache entries to drop, oldest first, until both bounds hold.

    ``index`` has key, cached_at, bytes.  Nothing goes while both limits are kept; beyond
    them the count falls to ``max_entries - spare`` and the bytes to a share of the limit.
    """
    total = index.agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
    joined = global_positions(
        index, [F.col("cached_at").asc(), F.col("key").asc()], "age_rank",
        {"bytes_through": F.col("bytes")}).withColumns(
            {"_n": total.select("_n").scalar(), "_b": total.select("_b").scalar()})
    over = (F.col("_n") > max_entries) | (F.col("_b") > max_bytes)
    left_n = F.col("_n") - (F.col("age_rank") - 1)
    left_b = F.col("_b") - (F.col("bytes_through") - F.col("bytes"))
    needed = (left_n > max_entries - spare) | (left_b > max_bytes * keep_share)
    return joined.filter(over & needed).select(*index.columns)


def seen_and_version(snapshots: DataFrame) -> DataFrame:
    """First and last seen time and version number of every dataset.

    ``snapshots`` has gse_id, taken_at, metadata_hash.  A version starts where the hash
    differs from the snapshot before; the previous row is found by joining on position, so
    a dataset with very many snapshots still spreads.
    """
    placed = global_positions(snapshots, [F.col("gse_id"), F.col("taken_at")], "_at")
    previous = placed.select((F.col("_at") + 1).alias("_at"), F.col("gse_id").alias("_pid"),
                             F.col("metadata_hash").alias("_phash"))
    step = placed.join(previous, "_at", "left").withColumn(
        "_changed", F.when(F.col("_pid") == F.col("gse_id"),
                           (F.col("_phash") != F.col("metadata_hash")).cast("long"))
        .otherwise(F.lit(0)))
    return step.groupBy("gse_id").agg(
        F.min("taken_at").alias("first_seen_at"), F.max("taken_at").alias("last_updated"),
        (F.sum("_changed") + 1).alias("version"), F.count(F.lit(1)).alias("snapshots"))
