"""Helpers shared by the corpus operators: clean inputs, Arrow row maps, cell joins, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.session import cut_lineage

#: Stands for a null id inside a job; given back as null.
NULL_ID = -(1 << 63)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``: other columns go, a null text is empty, a null id
    becomes ``NULL_ID``."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def public_id(column: str = "doc_id") -> Column:
    """The id as it was given."""
    return F.nullif(F.col(column), F.lit(NULL_ID)).alias(column)


_PIECE = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some MB."""
    for batch in batches:
        step = max(1, int(batch.num_rows * _PIECE / max(batch.nbytes, _PIECE)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str,
             done: Callable[[], None] | None = None) -> DataFrame:
    """Some rows in, some out, in pieces of some MB, so long texts don't add up; ``rows`` gives the
    columns by name.  ``done`` runs at the end of a partition: workers live on, what it frees is
    there for the next stage."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = rows(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[n]) if not isinstance(
                out[n], pa.Array) else out[n] for n in names], names)
        if done:
            done()
        release()
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives unused memory back to the machine, Arrow's and, where the C library can, its own:
    workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def whole_partition(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of one shuffle partition; its size is what the shuffle was asked for."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


#: Rows of a lookup table up to which it is sent whole to every task.
LOOKUP_ROWS = 100_000


def lookup(small: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it was counted to have few rows; else joined as any other."""
    return F.broadcast(small) if rows <= LOOKUP_ROWS else small


def block_pairs(df: DataFrame, member: str, block_rows: int = 2048, size: Column | None = None) -> DataFrame:
    """Deals the rows of every ``cell`` into groups of bounded size that meet every pair.

    Small cells stay one group.  A cell with more than ``block_rows`` rows is cut into blocks by
    a hash of ``member``; block i meets block j in group (i, j), so the work of one hot cell is
    spread over many tasks.  Adds ``block``, ``left`` and ``right``: pairs count when both rows
    are of the same block where left = right, and of different blocks otherwise.  With ``size`` a row
    counts as so many.
    """
    counted = F.sum(F.lit(1) if size is None else size).alias("count")
    large = cut_lineage(df.groupBy("cell").agg(counted).filter(F.col("count") > block_rows)
                        .select("cell", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    dealt = (df.join(lookup(large, large.count()), "cell", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return (dealt.withColumn("left", F.least("block", "other"))
            .withColumn("right", F.greatest("block", "other")).drop("other", "blocks"))


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None):
    """Joins indices along pairs (a, b): the parents, flattened, and which pairs joined anything."""
    parent = np.arange(n) if parent is None else parent
    used = []
    apart = np.flatnonzero(parent[a] != parent[b])
    for k in apart:
        x, y = int(a[k]), int(b[k])
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = int(parent[y])
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(k)
    if used:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent, np.array(used, dtype=np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = longs(batch, "a"), longs(batch, "b")
        if not len(a):
            continue
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent, _ = forest(len(names), at[:len(a)], at[len(a):])
        own = np.flatnonzero(parent != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[own]), pa.array(names[parent[own]])], ["a", "b"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges dealt by their larger end the stars of what they join here; ``moved`` where edges were others before."""
    table = whole_partition(batches)
    if table is None:
        return
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, _ = forest(len(names), at[:len(a)], at[len(a):])
    moved = bool(table.column("moved").to_numpy().any() or (parent[at[:len(a)]] != at[len(a):]).any())
    own = np.flatnonzero(parent != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[own]), pa.array(names[parent[own]]), pa.array(np.full(len(own), moved))], ["a", "b", "moved"])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable along edges (a, b), for nodes with an edge.

    Edges first shrink to stars inside each batch, then two steps alternate until nothing changes.  Large star: the
    lesser end of each edge gives way to its own least neighbour.  Small star: edges are dealt by their larger end, and
    what a task joins becomes stars.  A node is the larger end of one edge from each batch or task at most, so
    their number bounds what it brings to a task.  Only edges move, and never get more; a round is two shuffles and a checkpoint, so a
    lost executor costs one round.
    """
    narrow = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = narrow.mapInArrow(_stars, "a long, b long").withColumn("moved", F.lit(True))
    now = cut_lineage(now.repartition("a").mapInArrow(_joined, "a long, b long, moved boolean"))
    while True:
        count, moved = now.agg(F.count(F.lit(1)), F.max("moved")).first()
        if not moved:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        least = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")
        large = now.join(lookup(least, count), F.col("b") == F.col("at"), "left").select(
            "a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        now = cut_lineage(large.repartition("a").mapInArrow(_joined, "a long, b long, moved boolean"))
