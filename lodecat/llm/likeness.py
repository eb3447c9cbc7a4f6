"""Near copies by the likeness of their word shingles, through SimHash (the pipeline's stage 10).

Two texts are near copies if their sets of shingles have a Jaccard likeness of at least a
threshold t.  Candidates come by the operator's grid: fingerprints of at most ``DISTANCE`` differing bits
meet in cells of equal segment popcounts, and the sets decide.  At a likeness of 0.8, though, fingerprints differ in
about 12 of 64 bits, which no cell of 64 bits finds for sure.  So what the grid has not linked
meets once more by shingles, which is complete: in one order of all shingles, rare ones first,
sets that are so alike share one of their first ``n - ceil(t * n) + 1`` shingles.  Among those that meet, sizes,
the Manhattan distance of the segment popcounts (a lower bound), the differing bits and the shingles shared sort
candidates out, and again the sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import block_pairs, components, forest, longs, lookup, map_rows, pieces, release, texts, whole_partition
from lodecat.llm.simhash import fingerprint, grid_links, popcounts, shingle_hashes
from lodecat.session import cut_lineage

#: Rows of the sample that says which shingles are common, and common ones kept.  Both bear on
#: the order of shingles only: any order gives the same links.
SAMPLE_ROWS, COMMON = 8_000, 100_000
#: Differing bits allowed by default: five deviations (of 3) above the mean of 12 at a likeness of 0.8.
BITS = 28
#: The grid's widest distance and its groups; more bits need more cells than there are rare shingles.
DISTANCE, GROUPS = 5, 7
#: Thousands of shingles in a block of texts that are compared, blocks at least, and rows of a family's block.
CHUNK, BLOCKS, BLOCK_ROWS = 1024, 8, 1024
#: Shingles in a block of a family's texts.
BLOCK_SHINGLES = 1 << 17
#: Pairs, or cells or shingles of pairs, that a task looks at in one go.
HELD = 1 << 17


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _name(own: np.ndarray) -> int:
    """Names a set by 64 bits: the texts of one set are one node."""
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, likeness: float) -> np.ndarray:
    """The first shingles in the order of all: by count in the sample, then by value."""
    n = len(own)
    first = n - math.ceil(likeness * n - 1e-9) + 1
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[:first]]


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come more than twice in a sample, sorted, with their counts."""
    every = max(1, rows.count() // SAMPLE_ROWS)

    def single(batch: pa.RecordBatch) -> dict:
        own = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
        return {"s": np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)}
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text")
    often = map_rows(sample, single, "s long").groupBy("s").count().filter("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    common = often["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], often["count"].to_numpy(np.int64)[order]


def _decide(words: int, likeness: float):
    """Rows by (left, right): the texts of two blocks, then pairs among them; gives the pairs that are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, {}
        for batch in pieces(batches):
            out = []
            for left, right, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "a", "b", "text"))):
                if key != (left, right):
                    key, own = (left, right), {}
                if b is None:
                    own[a] = shingle_set(text, words)
                else:
                    x, y = own[a], own[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= likeness * (len(x) + len(y) - both) - 1e-9:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])
        del own
        release()
    return run


def _texts(asked: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``text`` of the asked nodes, read again."""
    own = cut_lineage(nodes.join(asked, "node", "left_semi").select("node", "doc_id", "mark"))
    return cut_lineage(rows.join(lookup(own, own.count()), ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"]))


def _alike(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, likeness: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike.

    Texts are read again, for the nodes of pairs only, and dealt in blocks of bounded size; a text goes once to each
    two blocks that hold a pair of it, however many pairs those are.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    size = nodes.join(asked, "node", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    text = _texts(asked, rows, nodes)
    blocks = max(BLOCKS, math.ceil(size / (CHUNK * 1024)))
    i, j = (F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int") for c in ("a", "b"))
    dealt = pairs.select(F.least(i, j).alias("left"), F.greatest(i, j).alias("right"), "a", "b")
    sent = cut_lineage(dealt.select("left", "right", F.explode(F.array("a", "b")).alias("node")).distinct())
    given = text.join(lookup(sent, sent.count()), "node").select("left", "right", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    met = given.union(dealt.withColumn("text", F.lit(None).cast("string")))
    met = met.repartition("left", "right").sortWithinPartitions("left", "right", F.asc_nulls_first("b"))
    return cut_lineage(met.mapInArrow(_decide(words, likeness), "a long, b long"))


def _needed(n: np.ndarray, m: np.ndarray, likeness: float) -> np.ndarray:
    """How many of their first shingles sets of n and m must share to be alike.

    Of what they share, all but the shingles after the first ones of one of them stands among the first ones of
    both, and those after are ``ceil(t * n) - 1`` of n.
    """
    def up(x: np.ndarray) -> np.ndarray:
        return np.ceil(x - 1e-9)
    return up((n + m) * (likeness / (1 + likeness))) - up(np.maximum(n, m) * likeness) + 1


def _candidates(table: pa.Table, likeness: float, bits: int | None):
    """The columns of a partition and its rows by place, then again and again the places (x, y) of pairs of one
    dealt cell that are not linked yet and may be alike by size and fingerprint; the Manhattan distance of the segments is asked
    before the bits."""
    col = {c: table.column(c).to_numpy() for c in ("cell", "left", "right", "block", "node", "n", "fp", "root")}
    order = np.lexsort((col["n"], col["right"], col["left"], col["cell"]))
    col = {c: v[order] for c, v in col.items()} | {"row": order}
    new = np.ones(len(order), bool)
    new[1:] = (col["cell"][1:] != col["cell"][:-1]) | (col["left"][1:] != col["left"][:-1]) | (col["right"][1:] != col["right"][:-1])
    group = np.cumsum(new)
    n, fp, split = col["n"], col["fp"].view(np.uint64), col["left"] != col["right"]
    grid = popcounts(fp)
    yield col
    here, shift = np.arange(len(n)), 0
    while True:  # the row with the one so many places on, while cell and size hold
        shift += 1
        here = here[here + shift < len(n)]
        there = here + shift
        here = here[(group[here] == group[there]) & (n[here] >= likeness * n[there] - 1e-9)]
        if not len(here):
            return
        x, y = here, here + shift
        ok = (col["root"][x] != col["root"][y]) & (~split[x] | (col["block"][x] != col["block"][y]))
        x, y = x[ok], y[ok]
        if bits is not None:
            ok = np.abs(grid[x] - grid[y]).sum(1, dtype=np.int16) <= bits
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(fp[x] ^ fp[y]) <= bits
            x, y = x[ok], y[ok]
        yield x, y


def _shared(table: pa.Table, rows: np.ndarray):
    """Counts the ``cells`` that the rows at places x and y have in common, pair by pair."""
    cells = table.column("cells").combine_chunks()
    size = np.diff(cells.offsets.to_numpy()).astype(np.int64)
    names, flat = np.unique(cells.flatten().to_numpy(), return_inverse=True)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    known = np.sort(np.repeat(place, size) * len(names) + flat)
    start, size = (np.cumsum(size) - size)[rows], size[rows]

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        end = np.cumsum(size[x])
        first = end - size[x]
        at = np.arange(end[-1]) + np.repeat(start[x] - first, size[x])
        asked = np.repeat(y, size[x]) * len(names) + flat[at]
        found = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        return np.add.reduceat(found, first, dtype=np.int64)
    return count


def _asked(likeness: float, bits: int | None):
    """Of each dealt family, the members that have a candidate in it: each once, however many they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_partition(batches)
        if table is None:
            return
        found = _candidates(table, likeness, bits)
        col = next(found)
        count, asked = _shared(table, col["row"]), np.zeros(len(col["row"]), bool)
        wide = max(1, int(table.column("wide").to_numpy().max()))
        for x, y in found:
            for at in range(0, len(x), max(1, HELD // wide)):
                a, b = x[at:at + max(1, HELD // wide)], y[at:at + max(1, HELD // wide)]
                ok = count(a, b) >= _needed(col["n"][a], col["n"][b], likeness)
                asked[a[ok]] = asked[b[ok]] = True
        yield pa.RecordBatch.from_arrays([pa.array(col[c][asked]) for c in ("cell", "node")], ["cell", "node"])
        del table, col, count, found
        release()
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each dealt family, one after the other, of rows sorted by family."""
    key, held = None, []
    for batch in pieces(batches):
        own = np.stack([longs(batch, c).astype(np.int64) for c in ("cell", "left", "right")], 1)
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1).tolist(), len(own)]
        for at, to in zip(cuts, cuts[1:]):
            if held and tuple(own[at]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(own[at])
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def _forest(table: pa.Table, words: int, likeness: float) -> list[tuple[int, int]]:
    """Links between members of one dealt family whose sets are alike; none inside what is linked."""
    sets = [shingle_set(t, words) for t in table.column("text").to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    own, n = [flat[ends[k] - n[k]:ends[k]] for k in order], n[order]
    node, block = longs(table, "node")[order], longs(table, "block")[order]
    split = bool((longs(table, "left") != longs(table, "right"))[0])
    _, first, root = np.unique(longs(table, "root")[order], return_index=True, return_inverse=True)
    parent, mark, out = first[root], np.zeros(len(flat), bool), []
    for x in range(len(n) - 1):
        y = np.arange(x + 1, np.searchsorted(n, n[x] / likeness + 1e-6, side="right"))
        y = y[parent[y] != parent[x]]
        if split:
            y = y[block[y] != block[x]]
        mark[own[x]] = True
        while len(y):  # in parts of bounded size; who gets linked meanwhile is not asked
            part = y[:max(1, int(np.searchsorted(np.cumsum(n[y]), HELD)))]
            both = np.add.reduceat(mark[np.concatenate([own[k] for k in part])], np.cumsum(n[part]) - n[part], dtype=np.int64)
            alike = part[both >= likeness * (n[x] + n[part] - both) - 1e-9]
            parent, used = forest(len(n), np.full(len(alike), x), alike, parent)
            out += [(int(node[x]), int(node[k])) for k in alike[used]]
            y = y[len(part):]
            y = y[parent[y] != parent[x]]
        mark[own[x]] = False
    return out


def _linked(words: int, likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            out = _forest(table, words, likeness)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])
        release()
    return run


def _families(rest: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, likeness: float, bits: int | None) -> DataFrame:
    """Links that join what is alike among the rows of ``rest``, complete, and no more than a forest of each dealt family.

    The cells of one smallest node are one family: near copies share most of their cells, so a member stands in a
    few families, not in each of its cells, and pairs meet where the sets are, not as rows.  A member is told with all its
    cells, so a family sees how many a pair shares; texts go to the members that have a candidate there.
    """
    least = rest.groupBy("cell").agg(F.min("node").alias("family"))
    own = rest.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("root").alias("root"), F.collect_list("cell").alias("cells"))
    member = rest.join(least, "cell").select(F.col("family").alias("cell"), "node").distinct()
    told = cut_lineage(member.join(own.withColumn("wide", F.size("cells")), "node"))
    dealt = block_pairs(told, "node", BLOCK_ROWS, F.ceil(F.col("wide") / 64)).repartition("cell", "left", "right")
    asked = cut_lineage(dealt.mapInArrow(_asked(likeness, bits), "cell long, node long").distinct())
    text = _texts(asked.select("node").distinct(), rows, nodes)
    ready = told.select("cell", "node", "n", "root").join(asked, ["cell", "node"])
    dealt = block_pairs(cut_lineage(ready), "node", BLOCK_SHINGLES, F.col("n")).join(text, "node")
    dealt = dealt.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right")
    return cut_lineage(dealt.mapInArrow(_linked(words, likeness), "a long, b long"))


def _mixed(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of those cells that hold nodes not linked with each other yet, with their ``root``."""
    rooted = cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("cell")
    return cut_lineage(rooted.join(mixed, "cell", "left_semi"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, likeness: float = 0.8,
                bits: int | None = BITS) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``component`` for every row: rows of one
    component are linked by near copies.

    Texts are nodes, not ids: rows that share an id, or have none, are linked only by their texts.
    Texts of equal sets are one node; a text of fewer words is one shingle; texts without words are
    one node.  First fingerprints meet in the grid of ``simhash``, where each group sends on a spanning forest.  What is
    linked by then is not compared again, and the rest meets in full, in families of cells and in blocks, inside tasks:
    candidates and pairs that turn out unlike make no rows, so large groups of copies cost no square of rows.
    Pairs count the cells that they share; too few, and the sets cannot be alike.
    With ``bits`` None no fingerprint sorts out candidates, and links are exact in every case; else a
    pair at the threshold is missed if its fingerprints differ in more bits, one in some million.
    ``doc_id`` is ``NULL_ID`` where it is null.  An empty table gives no rows.

    Rows on disk are narrow: signatures with the first shingles, cells with two longs, and the texts
    of those nodes that have a candidate.
    """
    rows = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    common, counts = _common(rows, words)

    def sign(batch: pa.RecordBatch) -> dict:
        own = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
        first = [prefix(s, common, counts, likeness).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in own]
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "node": np.array([_name(s) for s in own], np.int64),
                "n": np.array([len(s) for s in own], np.int32), "fp": np.array([fingerprint(s) for s in own], np.uint64).view(np.int64),
                "cells": pa.array(first, pa.list_(pa.int64()))}
    named = cut_lineage(map_rows(rows, sign, "doc_id long, mark long, node long, n int, fp long, cells array<long>"))
    nodes = cut_lineage(named.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.min("n").alias("n"), F.min("fp").alias("fp"))
                        .select("node", "row.doc_id", "row.mark", "n", "fp"))
    prints = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(prints, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = grid_links(prints, DISTANCE, GROUPS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = components(_alike(cut_lineage(near.union(same)), rows, nodes, words, likeness))
    cells = named.select("node", F.explode("cells").alias("cell"))
    tops = cells.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("cell")
    shared = cells.join(tops, "cell").select("cell", "node").distinct()
    rest = _mixed(shared.join(nodes.select("node", "n", "fp"), "node"), roots)
    more = _families(rest, rows, nodes, words, likeness, bits)
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    return named.select("doc_id", "mark", "node").join(final, "node", "left").select(
        "doc_id", "mark", F.coalesce("root", "node").alias("component"))
