"""Centroid clustering over bit planes (13).

Every vector is 64 integers; bit plane i holds bit i of all 64 components in one unsigned 64-bit
word, the top plane carries the sign (two's complement).  With plane weights w, the dot product of
two vectors is the sum of ``w[i] * w[j] * popcount(x[i] & c[j])``: exact, and so are distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecat.llm.common import map_rows
from lodecat.llm.topk import integers
from lodecat.session import cut_lineage

DIM = 64
#: Components beyond it would let a squared distance leave 64 bits.
LARGEST = 1 << 27


def weights(planes: int) -> np.ndarray:
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """A row of ``planes`` words for each row of 64 integers."""
    bits = ((values[:, None, :] >> np.arange(planes)[:, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products of plane rows, every row of ``x`` with every row of ``c``."""
    wx, wc = weights(x.shape[1]), weights(c.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(x.shape[1]):
        for j in range(c.shape[1]):
            out += wx[i] * wc[j] * np.bitwise_count(x[:, i, None] & c[None, :, j]).astype(np.int64)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths of plane rows."""
    w, out = weights(x.shape[1]), np.zeros(len(x), np.int64)
    for i in range(x.shape[1]):
        for j in range(i + 1):
            out += (1 + (i != j)) * w[i] * w[j] * np.bitwise_count(x[:, i] & x[:, j]).astype(np.int64)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each plane row (ties: the smaller number) and its squared distance."""
    far = squares(x)[:, None] - 2 * dots(x, centroids) + squares(centroids)[None, :]
    pick = far.argmin(1)
    return pick, far[np.arange(len(x)), pick]


def plane_sums(x: np.ndarray, pick: np.ndarray, k: int) -> np.ndarray:
    """Sums of the 64 components of the rows of each cluster, counted plane by plane."""
    w, out = weights(x.shape[1]), np.zeros((k, DIM), np.int64)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.shape[1], 8), axis=2, bitorder="little")
    for c in np.unique(pick):
        out[c] = (bits[pick == c].sum(0, dtype=np.int64) * w[:, None]).sum(0)
    return out


def _planes(batch: pa.RecordBatch, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint64).reshape(-1, planes)


_BATCH = 1 << 14


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` for
    every vector of exactly 64 components, none null or non-finite; others give no row.

    Components are ``floor(scale * x)``.  Centroids start as the k vectors of smallest sha256 of
    ``seed:vec_id`` (a null id counts as the word ``null``; rows that share an id go by their components),
    fewer if there are fewer vectors.  Each round assigns every vector, then replaces the centroids
    of clusters with members by the floor of the mean; empty ones stay.  Repeated rows each get a row.
    An empty table gives no rows.  Components of more than ``LARGEST`` are refused, as distances
    would not fit in 64 bits.

    Tasks send one row of sums per cluster and partition; the driver holds k centroids.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("v")).filter(F.size("v") == DIM)
    low, high = given.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if low is None:
        return spark.createDataFrame([], schema)
    if max(-low, high) > LARGEST:
        raise ValueError(f"components reach from {low} to {high} after scaling; at most {LARGEST} is allowed")
    planes = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0) + 1
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    centroids = np.array([r["v"] for r in given.orderBy(key, "v").limit(k).select("v").collect()], np.int64)
    k = len(centroids)

    def pack(batch: pa.RecordBatch) -> dict:
        v = batch.column("v").flatten().to_numpy().reshape(-1, DIM)
        return {"vec_id": batch.column("vec_id"), "planes": pa.array([r.tobytes() for r in to_planes(v, planes)], pa.binary())}
    held = cut_lineage(map_rows(given, pack, "vec_id long, planes binary"))

    def totals(start: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, sums = np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
            own = to_planes(start, planes)
            for whole in batches:
                for at in range(0, whole.num_rows, _BATCH):
                    x = _planes(whole.slice(at, _BATCH), planes)
                    pick, _ = nearest(x, own)
                    count += np.bincount(pick, minlength=k)
                    sums += plane_sums(x, pick, k)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *[pa.array(sums[some, d]) for d in range(DIM)]],
                                             ["cluster", "n", *[f"s{d}" for d in range(DIM)]])
        return run
    narrow = ", ".join(["cluster int", "n long", *[f"s{d} long" for d in range(DIM)]])
    for _ in range(rounds):
        parts = held.select("planes").mapInArrow(totals(centroids), narrow)
        told = parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{d}" for d in range(DIM)])]).collect()
        centroids = centroids.copy()
        for r in told:  # one row of a cluster
            centroids[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(DIM)]
    last = to_planes(centroids, planes)

    def assign(batch: pa.RecordBatch) -> dict:
        pick, far = nearest(_planes(batch, planes), last)
        return {"vec_id": batch.column("vec_id"), "cluster": pick.astype(np.int32), "distance": far}
    done = cut_lineage(map_rows(held, assign, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fields = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
                           T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    summary = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], fields)
    return done.join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
