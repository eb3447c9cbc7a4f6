"""Embedding near-duplicates by iterative quantisation (4).

A rotation is learned so that the signs of the rotated, centred vectors are balanced codes with
little loss.  The codes are cut into substrings, one hash table each (multi-index); vectors that
share a substring are candidates, and the original vectors decide by cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import NULL_ID, block_pairs, components, forest, map_rows, public_id, whole_partition
from lodecat.session import cut_lineage


def learn_rotation(x: np.ndarray, seed: int = 0, rounds: int = 40) -> np.ndarray:
    """The orthogonal matrix of one run of iterative quantisation over centred rows."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    for _ in range(rounds):
        code = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(code.T @ x)
        r = (u @ v).T
    return r


#: Tables at most, if the bits are not given: shorter substrings take the place of more tables.
TABLES = 64


def tables_for(rows: int, bits: int | None, cosine: float, miss: float, radius: float = 1.0) -> tuple[int, int]:
    """(bits of a substring, number of tables): cells of some hundred vectors, and so many tables
    that a pair at the threshold shares a substring but for ``miss``.

    Codes come from centred vectors.  Unit vectors at the threshold are a chord apart, which a
    point at ``radius`` from both sees under a larger angle the nearer it is.  No bits, one table:
    every pair is compared.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * cosine))
    agree = 1 - 2 * math.asin(min(1.0, chord / (2 * radius) if radius > 0 else 1.0)) / math.pi
    most = bits or int(min(24, max(8, round(math.log2(max(rows, 1) / 200)))))
    for own in range(most, 0, -1):
        same = agree ** own
        if same >= 1:
            return own, 1
        if same > 1e-9:
            tables = math.ceil(math.log(miss) / math.log1p(-same))
            if bits or tables <= TABLES:
                return own, tables
    return 0, 1


def _tasks(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_partition(batches)
        if table is None:
            return
        names = ("cell", "left", "right", "block", "table", "rep", "mult")
        cell, left, right, block, turn, rep, mult = (table.column(c).to_numpy() for c in names)
        rows = table.column("unit").combine_chunks()
        units = np.asarray(rows.values).reshape(len(cell), -1)
        codes = table.column("code").combine_chunks()
        codes = np.asarray(codes.values).reshape(len(cell), -1)
        order = np.lexsort((right, left, cell))
        key = np.stack([cell, left, right])[:, order]
        begin = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        links, edges = {}, []
        for a, b in zip(begin, np.r_[begin[1:], len(order)]):
            if b - a < 2:
                continue
            at = order[a:b]
            own = int(turn[at[0]])
            parent = np.arange(len(at))
            for lo in range(0, len(at), 512):
                sim = units[at[lo:lo + 512]] @ units[at].T
                x, y = np.nonzero(sim >= cosine)
                x = x + lo
                keep = x < y
                x, y = x[keep], y[keep]
                if left[at[0]] != right[at[0]]:
                    cross = block[at[x]] != block[at[y]]
                    x, y = x[cross], y[cross]
                if own:  # a pair counts in the first table that it shares
                    fresh = ~(codes[at[x], :own] == codes[at[y], :own]).any(1)
                    x, y = x[fresh], y[fresh]
                for p, q in ((at[x], at[y]), (at[y], at[x])):
                    ids, inv = np.unique(rep[p], return_inverse=True)
                    for i, n in zip(ids.tolist(), np.bincount(inv, mult[q]).tolist()):
                        links[i] = links.get(i, 0) + int(n)
                parent, used = forest(len(at), x, y, parent)
                edges.append(np.stack([rep[at[x[used]]], rep[at[y[used]]]]))
        a, b = np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.int64)
        n = len(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.fromiter(links, np.int64, n), a]), pa.array([*links.values(), *[None] * len(a)], pa.int64()),
             pa.array([*[None] * n, *b.tolist()], pa.int64())], ["a", "links", "b"])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                    sample_rows: int = 20_000, bits: int | None = None, miss: float = 0.01, seed: int = 0) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Tables are chosen by the distances from the sample's mean, of which one in a hundred is nearer.
    The rotation is learned on at most ``sample_rows`` vectors, taken by a hash of the id; every
    vector is indexed.  Equal vectors collapse first and are counted, not paired.  A cell with
    very many vectors is dealt in blocks over tasks; tasks send counts and a spanning forest.
    Null, zero and non-finite vectors link with nothing, nor do vectors whose length is not the
    sample's commonest.  Vectors are told apart by their components, not by their ids: rows that share an
    id, or have none, count as vectors of their own, and repeated rows each get a row and link.  A null id
    stays null and counts as the smallest.
    """
    ok = (F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists("v", lambda x: x != 0))
    raw = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = raw.withColumn("k1", F.when(ok, F.xxhash64("v"))).withColumn("k2", F.when(ok, F.xxhash64(F.lit(1), F.col("v"))))
    live = fine.filter("k1 is not null")
    sample = [r for r in live.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()]
    if not sample:
        return raw.select(public_id("vec_id"), F.lit(0).cast("long").alias("n_links"), public_id("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sizes = np.bincount([len(r["v"]) for r in sample])
    dim = int(sizes.argmax())
    x = np.array([r["v"] for r in sample if len(r["v"]) == dim])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(0)
    classes = cut_lineage(live.filter(F.size("v") == dim).groupBy("k1", "k2").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")).withColumn("rep", F.monotonically_increasing_id()))
    radius = float(np.quantile(np.linalg.norm(x - centre, axis=1), 0.01))
    width, tables = tables_for(classes.count(), bits, cosine, miss, radius)
    per = max(1, dim // max(1, width))
    turns = np.stack([learn_rotation(x - centre, seed + k) for k in range(math.ceil(tables / per))])

    def index(batch: pa.RecordBatch) -> dict:
        v = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, dim)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        signs = np.concatenate([(unit - centre) @ r >= 0 for r in turns], 1)
        step = (np.arange(tables) // per) * dim + np.arange(tables) % per * width
        code = np.stack([signs[:, s:s + width] @ (1 << np.arange(min(width, dim))) for s in step], 1).astype(np.int32)
        n, t = code.shape
        cell = (np.arange(t, dtype=np.int64) << 32)[None, :] + code
        rep, mult = (batch.column(c).to_numpy() for c in ("rep", "mult"))
        return {"cell": cell.ravel(), "table": np.tile(np.arange(t, dtype=np.int32), n), "rep": np.repeat(rep, t), "mult": np.repeat(mult, t),
                "code": pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(code, t, 0).ravel()), t).cast(pa.list_(pa.int32())),
                "unit": pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(unit, t, 0).ravel()), dim).cast(pa.list_(pa.float64()))}
    cells = map_rows(classes.select("rep", "mult", "v"), index, "cell long, table int, rep long, mult long, code array<int>, unit array<double>")
    found = cut_lineage(block_pairs(cells, "rep", 1024).repartition("cell", "left", "right").mapInArrow(
        _tasks(cosine), "a long, links long, b long"))
    direct = found.filter("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null"))
    told = cut_lineage(classes.select("k1", "k2", "rep", "low", "mult").join(direct, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
                       .select("k1", "k2", "low", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("root", "rep").alias("group")))
    least = told.groupBy("group").agg(F.min("low").alias("root"))
    told = told.join(least, "group").select("k1", "k2", "links", "root")
    return fine.select("vec_id", "k1", "k2").join(told, ["k1", "k2"], "left").select(
        public_id("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(F.coalesce("root", "vec_id"), F.lit(NULL_ID)).alias("component_id"), (F.col("vec_id") == F.coalesce("root", "vec_id")).alias("kept"))
