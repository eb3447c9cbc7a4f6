"""Exact top-k search by block-at-a-time pruning (11).

The weight of term t in a vector is its integer component t.  Documents are put in an order in
which vectors of the same strongest terms are neighbours, and cut into ranges, one task each, and
blocks inside them.  A block keeps the maxima of its terms (of either sign) and a forward index,
the matrix of its vectors.  A query orders the blocks by the sum of its weights times the block's
term maxima, scores block after block through the forward index, and stops where the sums fall
below its kth score; equal sums are still scored, as ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecat.llm.common import longs, map_rows
from lodecat.operators.order import global_positions
from lodecat.session import cut_lineage

#: Components beyond it would let a score of 64 terms leave 64 bits.
LARGEST = 1 << 27
#: Rows of a range at most: what one task holds, 64 terms of four bytes each.
RANGE_ROWS = 1 << 18
#: Ranges whose term maxima (one row of a range) are sent to all tasks, 8192 x 64 x 2 numbers;
#: with more ranges a query asks every range and is turned away there by the same sums.
SENT_RANGES = 1 << 13
#: Queries that one copy of a range serves.
SLICE = 1 << 18
NONE = -(1 << 63)


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component as long; null if the vector is null or a component
    is null or not finite."""
    v = vector.cast("array<double>")
    ok = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(ok, F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def sums_of_maxima(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block, the greatest score that a vector within the maxima could have."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class Blocks:
    """One range of documents: blocks with maxima and forward index."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, places: np.ndarray, size: int):
        self.rows, self.ids, self.places, self.size = rows, ids, places, size
        order = np.lexsort((places, ids))
        self.tie = np.empty(len(ids), np.int64)
        self.tie[order] = np.arange(len(ids))
        starts = np.arange(0, len(rows), size)
        self.high, self.low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
        self.scored = self.asked = 0

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """Index of the query, row and score of each query's k best, none below its floor.

        Blocks are taken in order of their sums, 1, 2, 4 ... at a time, so that the queries which
        want a block are scored together.
        """
        bounds = sums_of_maxima(queries, self.high, self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        kth = floor.astype(np.int64)
        at, width, blocks = 0, 1, bounds.shape[1]
        self.asked += bounds.size
        while at < blocks:
            took = order[:, at:at + width]
            asks = np.nonzero(np.take_along_axis(bounds, took, 1) >= kth[:, None])
            if not len(asks[0]):
                break
            q, b = asks[0], took[asks]
            by = np.argsort(b, kind="stable")
            q, b = q[by], b[by]
            self.scored += len(q)
            found = [held]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine, first = q[lo:hi], int(b[lo]) * self.size
                scores = queries[mine] @ self.rows[first:first + self.size].T
                x, y = np.nonzero(scores >= kth[mine][:, None])
                row = y + first
                other = self.places[row] != own[mine[x]]
                x, y, row = x[other], y[other], row[other]
                found.append((mine[x], row, scores[x, y].astype(np.int64)))
            q, row, score = (np.concatenate(c) for c in zip(*found))
            best = np.lexsort((self.tie[row], -score, q))
            q, row, score = q[best], row[best], score[best]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            keep = nth < k
            held = (q[keep], row[keep], score[keep])
            full = nth == k - 1
            kth[q[full]] = np.maximum(kth[q[full]], score[full])
            at, width = at + width, width * 2
        return held


def _number(largest: int, dim: int):
    """The narrowest numbers in which a score is exact."""
    top = dim * largest * largest
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _matrix(column: pa.ChunkedArray | pa.Array, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dim).astype(dtype)


def _visit(dim: int, size: int, k: int, dtype, batch_rows: int = 2048):
    """Rows come by (area, slice), documents first, then the queries that visit them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, blocks = None, [], None
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                keys = np.stack([longs(batch, "area"), longs(batch, "slice"), longs(batch, "asks")])
                cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0), True])
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    part, now = batch.slice(lo, hi - lo), (int(keys[0, lo]), int(keys[1, lo]))
                    if now != key:
                        key, docs, blocks = now, [], None
                    rows = _matrix(part.column("v"), dtype, dim)
                    if not keys[2, lo]:
                        docs.append((rows, part.column("id").fill_null(NONE).to_numpy(), longs(part, "place")))
                        continue
                    if blocks is None:
                        if not docs:
                            continue
                        blocks, docs = Blocks(*(np.concatenate(c) for c in zip(*docs)), size), []
                    q, row, score = blocks.search(rows, longs(part, "place"), longs(part, "floor"), k)
                    asked = part.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([asked.column("place"), asked.column("id"), pa.array(blocks.places[row]), pa.array(blocks.ids[row]), pa.array(score)],
                                                     ["query", "query_id", "place", "vec_id", "score"])
    return run


def _extremes(dim: int):
    def rows(batch: pa.RecordBatch) -> dict:
        v, area = _matrix(batch.column("v"), np.int64, dim), longs(batch, "area")
        names, at = np.unique(area, return_inverse=True)
        high, low = np.full((len(names), dim), NONE, np.int64), np.full((len(names), dim), -NONE - 1, np.int64)
        np.maximum.at(high, at, v)
        np.minimum.at(low, at, v)
        n = np.tile(np.arange(dim), len(names))
        return {"area": np.repeat(names, dim), "term": n, "high": high.ravel(), "low": low.ravel()}
    return rows


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
          range_rows: int | None = None, block_rows: int = 64) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for every row for which ``queries`` holds, the k
    rows of greatest inner product of integers ``floor(scale * x)``, its own row left out.

    Ties go to the smaller vec_id, a null id before all.  Null vectors and those with a null or
    non-finite component take no part; a shorter vector lacks its last terms, which count zero.
    Repeated rows, and rows that share an id, are rows of their own, as queries and as answers.
    A query with fewer than k others gives all; an empty table gives no rows.  Components of more
    than ``LARGEST`` are refused, as scores would not fit in 64 bits.

    A query first visits its own range, which gives it a kth score, then those other ranges whose
    term maxima reach that score.  ``range_rows`` follows from the rows and the cores, up to
    ``RANGE_ROWS``; it bears on the work, not on the result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"),
                           F.coalesce(queries, F.lit(False)).alias("asks")).filter("v is not null")
    dim, largest, rows, asked = given.agg(F.max(F.size("v")), F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))),
                                          F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if largest > LARGEST:
        raise ValueError(f"a component is {largest} after scaling; at most {LARGEST} is allowed")
    dim = max(dim, 1)
    size = range_rows or max(block_rows, min(RANGE_ROWS, math.ceil(rows / (3 * spark.sparkContext.defaultParallelism))))

    def pack(batch: pa.RecordBatch) -> dict:
        lists = batch.column("v")
        if not batch.num_rows:
            return {"id": batch.column("id"), "asks": batch.column("asks"), "terms": [], "v": pa.array([], pa.binary())}
        lengths = lists.value_lengths().to_numpy()
        v = np.zeros((batch.num_rows, dim), np.int32)
        v[np.arange(dim) < lengths[:, None]] = lists.flatten().to_numpy()
        strongest = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :3]
        terms = np.zeros(batch.num_rows, np.int64)
        for t in strongest.T:
            terms = (terms << 20) + np.minimum(2 * t + (v[np.arange(len(v)), t] > 0), (1 << 20) - 1)
        return {"id": batch.column("id"), "asks": batch.column("asks"), "terms": terms, "v": pa.array([r.tobytes() for r in v], pa.binary())}
    packed = map_rows(given, pack, "id long, asks boolean, terms long, v binary")
    placed = global_positions(packed, [F.col("terms"), F.xxhash64("v"), F.col("id")], "place").select(
        "id", "asks", "v", "place", F.floor((F.col("place") - 1) / size).cast("long").alias("area"))
    areas, slices = math.ceil(rows / size), math.ceil(asked / SLICE)
    dtype = _number(largest, dim)
    part = F.pmod("place", F.lit(slices)).alias("slice")

    def visit(asks: DataFrame) -> DataFrame:
        held = placed.select("area", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")).alias("slice"), F.lit(0).alias("asks"),
                             "place", "id", "v", F.lit(NONE).alias("floor"))
        come = asks.select("area", part, F.lit(1).alias("asks"), "place", "id", "v", "floor")
        dealt = held.union(come).repartition(areas * slices, "area", "slice").sortWithinPartitions("area", "slice", "asks", "place")
        return cut_lineage(dealt.mapInArrow(_visit(dim, block_rows, k, dtype), "query long, query_id long, place long, vec_id long, score long"))

    questions = placed.filter("asks")
    home = visit(questions.withColumn("floor", F.lit(NONE)))
    floors = home.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(NONE).alias("floor"))
    found = home
    if areas > 1:
        wanting = questions.join(floors, questions.place == floors.query, "left").select("area", "place", "id", "v", F.coalesce("floor", F.lit(NONE)).alias("floor"))
        high = low = None
        if areas <= SENT_RANGES:
            told = map_rows(placed.select("area", "v"), _extremes(dim), "area long, term long, high long, low long").groupBy("area", "term").agg(
                F.max("high").alias("high"), F.min("low").alias("low")).toPandas()
            high, low = (told.pivot(index="area", columns="term", values=c).sort_index().to_numpy() for c in ("high", "low"))

        def spread_out(batch: pa.RecordBatch) -> dict:
            own, floor = longs(batch, "area"), longs(batch, "floor")
            ask = np.ones((batch.num_rows, areas), bool)
            if high is not None:
                ask = sums_of_maxima(_matrix(batch.column("v"), np.int64, dim), high, low) >= floor[:, None]
            ask[np.arange(len(own)), own] = False
            q, area = np.nonzero(ask)
            at = pa.array(q)
            return {"area": area.astype(np.int64), **{c: batch.column(c).take(at) for c in ("place", "id", "v", "floor")}}
        found = home.union(visit(map_rows(wanting, spread_out, "area long, place long, id long, v binary, floor long")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NONE)).alias("vec_id"), "score")
