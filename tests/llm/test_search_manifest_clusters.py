"""Operators 11, 12 and 13 against plain versions, and their defined cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodecat.llm import clusters, merkle, topk

DOCS = "doc_id long, source string, lang string, n_chars long, text string, h string, grp string, tree long, pos long, root string"
NAN, INF = float("nan"), float("inf")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 -----------------------------------------------------------------------------------------
def vectors(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           *[T.StructField(c, T.StringType()) for c in ("id", "v", "asks", "place", "area", "score", "rank", "query")]])
    return spark.createDataFrame([(i, v, *["own"] * 8) for i, v in rows], schema)


def plain_top(rows, k, scale=256):
    held = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, x) in enumerate(held):
        if i is not None and i % 50 == 0:
            found = sorted((-sum(p * q for p, q in zip(x, y)), -(1 << 63) if j is None else j) for b, (j, y) in enumerate(held) if a != b)
            out += [(i, n + 1, None if j == -(1 << 63) else j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_rows,block_rows", [(1000, 7), (37, 4), (150, 64)])
def test_top_k_equals_every_score(spark, range_rows, block_rows):
    r = np.random.default_rng(1)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + r.normal(size=8) * 0.05).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(500, 520)]  # ties
    rows += [(50, [0.5] * 8), (50, [0.5] * 8), (None, [1.0] * 8), (None, [1.0] * 8)]  # repeated and missing ids
    rows += [(600, None), (650, [1.0, None] + [0.0] * 6), (700, [NAN] * 8), (750, [INF] * 8), (800, []), (850, [2.0, -1.0]), (900, [0.0] * 8)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, range_rows=range_rows, block_rows=block_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows, 5)


def test_top_k_small_and_large(spark):
    ask = F.col("vec_id") % 50 == 0
    assert topk.top_k(vectors(spark, [(0, [1.0])]).limit(0), ask).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0])]), ask).count() == 0
    few = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0])]
    assert sorted(map(tuple, topk.top_k(vectors(spark, few), ask).collect())) == plain_top(few, 5)
    big = [(i, [float(2 ** 18 + i), -3.0]) for i in range(120)]  # scores beyond 2 ** 53
    assert sorted(map(tuple, topk.top_k(vectors(spark, big), ask, range_rows=50).collect()), key=repr) == plain_top(big, 5)
    with pytest.raises(ValueError):
        topk.top_k(vectors(spark, [(0, [1e30])]), ask)


def test_blocks_are_left_out_where_sums_fall_short():
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 16)) * 100
    rows = np.floor(np.repeat(centres, 64, 0) + r.normal(size=(2560, 16))).astype(np.float64)
    blocks = topk.Blocks(rows, np.arange(2560), np.arange(2560), 64)
    ask = rows[::50]
    q, row, score = blocks.search(ask, np.arange(0, 2560, 50), np.full(len(ask), topk.NONE), 5)
    every = (ask @ rows.T).astype(np.int64)
    every[np.arange(len(ask)), np.arange(0, 2560, 50)] = topk.NONE
    want = np.sort(every, 1)[:, :-6:-1]
    assert (score.reshape(-1, 5) == want).all()
    assert blocks.scored < blocks.asked / 5


# 12 -----------------------------------------------------------------------------------------
def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    langs, out = {}, []
    for i, source, lang, n, text in rows:
        leaf = sha("".join(map(part, (i, source, lang, n, text))))
        bumped = sha("".join(map(part, (i, source, lang, n + 1, text)))) if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else leaf
        langs.setdefault(lang, []).append((-(1 << 63) if i is None else i, leaf, bumped))
    trees = {lang: (sorted(leaves), levels_of([h for _, h, _ in sorted(leaves)])) for lang, leaves in langs.items()}
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    over = levels_of([trees[lang][1][-1][0] for lang in order]) if order else [[None]]
    for at, lang in enumerate(order):
        leaves, tree = trees[lang]
        for k, (i, leaf, own) in enumerate(leaves):
            proof = []
            for levels, place in ((tree, k), (over, at)):
                for row in levels[:-1]:
                    other = row[place ^ 1] if place ^ 1 < len(row) else None
                    own = sha(own if other is None else other + own if place & 1 else own + other)
                    proof += [other] if other else []
                    place >>= 1
            root = over[-1][0]
            out.append((None if i == -(1 << 63) else i, leaf, tree[-1][0], root, sha("".join(proof)), own, own == root))
    return sorted(out, key=repr)


def doc_rows(n, seed=0):
    r = random.Random(seed)
    return [(i, r.choice(["s", None, "é"]), r.choice(["en", "en", "en", "de", None, ""]), r.choice([3, None, 0]), r.choice(["a", "", None, "über"])) for i in range(n)]


@pytest.mark.parametrize("rows", [doc_rows(1), doc_rows(2), doc_rows(17), doc_rows(300) + doc_rows(40),  # repeated rows
                                  doc_rows(60) + [(None, None, None, None, None)] * 3 + [(7, "x", "en", 1, "other"), (8, None, "en", None, "word " * 300_000)],
                                  [(i, "s", f"lang{i % 41}", 2, "t") for i in range(150)]])
def test_manifest_equals_plain(spark, rows):
    docs = spark.createDataFrame([(*r, *["own"] * 2, 1, 2, "own") for r in rows], DOCS)
    got = merkle.verify(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_over_several_blocks_and_storeys(spark):
    rows = [(i, None, "en" if i % 9 else "de", 1, "t") for i in range(2 * merkle.BLOCK + 900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert sorted(map(tuple, merkle.verify(docs).collect()), key=repr) == plain_manifest(rows)
    assert merkle.verify(docs.limit(0)).count() == 0


def test_versions_share_all_but_copied_nodes(spark):
    rows = [(i, None, "en" if i % 5 else "de", 1, "t") for i in range(900)]
    built = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    copies = {}
    for r in built.copies().collect():
        copies.setdefault(r["doc_id"], {})[r["level"]] = r["h"]
    ends = {r["doc_id"]: r["folded_root"] for r in built.proofs().collect()}
    hit = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 7 == 0}
    assert set(copies) == hit
    for i, nodes in copies.items():
        assert sorted(nodes) == list(range((10 if i % 5 else 8) + 2)) and nodes[max(nodes)] == ends[i] != built.root


# 13 -----------------------------------------------------------------------------------------
def plain_clusters(rows, k=16, rounds=3):
    held = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(held, key=lambda r: (sha(f"1:{'null' if r[0] is None else r[0]}"), r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in held]
    for _ in range(rounds):
        own = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(held, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own)
    return sorted(((i, c, d, sum(e for e, o in own if o == c), total, sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(held, own)), key=repr)


@pytest.mark.parametrize("rows", [
    [(i, (np.random.default_rng(i % 9).normal(size=64) + np.random.default_rng(i).normal(size=64) * 0.1).tolist()) for i in range(300)],
    [(i, [float(i % 3)] * 64) for i in range(40)] + [(3, [5.0] * 64), (3, [4.0] * 64), (None, [1.0] * 64), (None, [1.0] * 64)],  # ties, repeats, empty clusters
    [(1, [-0.001] * 64), (2, [1000.7] * 64), (3, [-1000.7] * 64), (4, None), (5, [1.0] * 63), (6, [NAN] * 64), (7, [None] * 64), (8, [INF] * 64), (9, [])]])
def test_clusters_equal_plain(spark, rows):
    got = clusters.cluster(vectors(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows)


def test_clusters_of_nothing(spark):
    table = vectors(spark, [(1, [1.0] * 64)])
    assert clusters.cluster(table.limit(0)).count() == 0 and clusters.cluster(vectors(spark, [(1, [1.0])])).count() == 0
    with pytest.raises(ValueError):
        clusters.cluster(vectors(spark, [(1, [1e20] * 64)]))


def test_planes_give_exact_products():
    r = np.random.default_rng(3)
    for top, planes in ((1, 2), (100, 8), (1 << 27, 29)):
        x, c = r.integers(-top, top + 1, (50, 64)), r.integers(-top, top + 1, (7, 64))
        a, b = clusters.to_planes(x, planes), clusters.to_planes(c, planes)
        assert (clusters.dots(a, b) == x @ c.T).all() and (clusters.squares(a) == (x * x).sum(1)).all()
        pick = r.integers(0, 5, 50)
        assert (clusters.plane_sums(a, pick, 5) == np.stack([x[pick == k].sum(0) for k in range(5)])).all()
