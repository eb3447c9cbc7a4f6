"""SimHash near-duplicates through a segment-popcount embedding (10).

A fingerprint of 64 bits maps to 32 coordinates, the popcounts of its two-bit segments.  The
Manhattan distance of two such vectors never exceeds their Hamming distance, so it filters without
loss.  The coordinates lie in groups; with at most d differing bits, all but d groups agree
entirely, so pairs meet in the grid cells made of ``groups - d`` equal groups.  Inside a cell the
rest's total popcount is a range key (at most d apart), the Manhattan distance filters, and the
bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import block_pairs, components, forest, longs, map_rows, public_id, texts, whole_partition

_CHUNK = 1 << 15
SEGMENTS = 32


def shingle_hashes(text: str, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z lowered; a shorter text is one shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    del parts
    first, last = np.concatenate([[0], ends[:-1]])[:len(ends) - words + 1], ends[words - 1:] - 1
    digest, out = xxhash.xxh64_intdigest, np.empty(len(first), np.uint64)
    for at in range(0, len(first), _CHUNK):  # of a long text no lists of all its places
        to = slice(at, at + _CHUNK)
        out[to] = [digest(line[a:b], seed) for a, b in zip(first[to].tolist(), last[to].tolist())]
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set where more than half of the hashes have it."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at:at + _CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a long) of every row, whole texts."""
    def rows(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(shingle_hashes(t, words, seed)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(found, np.uint64).view(np.int64)}
    return map_rows(texts(docs, id_col, text_col), rows, "doc_id long, fp long")


#: The two-bit popcounts of each byte, low bits first.
_PAIRS = np.bitwise_count((np.arange(256)[:, None] >> np.arange(0, 8, 64 // SEGMENTS)) & 3).astype(np.int8)


def popcounts(bits: np.ndarray) -> np.ndarray:
    """The embedding: a row of 32 two-bit popcounts for each fingerprint."""
    return _PAIRS[np.ascontiguousarray(bits, "<u8").view(np.uint8).reshape(-1, 8)].reshape(-1, SEGMENTS)


def _cells(groups: int, distance: int):
    spans = np.array_split(np.arange(SEGMENTS), groups)
    chosen = list(combinations(range(groups), groups - distance))
    wide = max(map(len, spans))

    def rows(batch: pa.RecordBatch) -> dict:
        fp = longs(batch, "fp")
        grid = popcounts(fp.view(np.uint64)).astype(np.int64)
        place = np.stack([grid[:, s] @ (3 ** np.arange(len(s))) for s in spans], 1)
        total = grid.sum(1)
        cell, rest = [], []
        for k, pick in enumerate(chosen):
            key = np.full(len(fp), k, np.int64)
            for g in pick:
                key = key * 3 ** wide + place[:, g]  # wraps for many groups: only more candidates
            cell.append(key)
            rest.append(total - sum(grid[:, spans[g]].sum(1) for g in pick))
        n = len(chosen)
        return {"cell": np.concatenate(cell), "rest": np.concatenate(rest).astype(np.int32),
                "fp": np.tile(fp, n), "rep": np.tile(longs(batch, "rep"), n)}
    return rows


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole_partition(batches)
        if table is None:
            return
        col = {c: table.column(c).to_numpy() for c in ("cell", "left", "right", "block", "rest", "fp", "rep")}
        order = np.lexsort((col["rest"], col["right"], col["left"], col["cell"]))
        col = {c: v[order] for c, v in col.items()}
        n, bits = len(order), col["fp"].view(np.uint64)
        grid = popcounts(bits)
        new = np.r_[True, (col["cell"][1:] != col["cell"][:-1]) | (col["left"][1:] != col["left"][:-1])
                    | (col["right"][1:] != col["right"][:-1])]
        group = np.cumsum(new)
        split = col["left"] != col["right"]
        parent, a_out, b_out = np.arange(n), [], []
        here, shift = np.arange(n), 0
        while True:  # the row with the one so many places on, while cell and range hold
            shift += 1
            here = here[here + shift < n]
            there = here + shift
            near = (group[here] == group[there]) & (col["rest"][there] - col["rest"][here] <= distance)
            here = here[near]
            if not len(here):
                break
            there = here + shift
            ok = ~split[here] | (col["block"][here] != col["block"][there])
            a, b = here[ok], there[ok]
            for at in range(0, len(a), 1 << 18):
                x, y = a[at:at + (1 << 18)], b[at:at + (1 << 18)]
                apart = parent[x] != parent[y]
                x, y = x[apart], y[apart]
                low = np.abs(grid[x] - grid[y]).sum(1, dtype=np.int16) <= distance
                x, y = x[low], y[low]
                close = np.bitwise_count(bits[x] ^ bits[y]) <= distance
                x, y = x[close], y[close]
                parent, used = forest(n, x, y, parent)
                a_out.append(x[used])
                b_out.append(y[used])
        if a_out:
            a, b = np.concatenate(a_out), np.concatenate(b_out)
            yield pa.RecordBatch.from_arrays([pa.array(col["rep"][a]), pa.array(col["rep"][b])], ["a", "b"])
    return run


def grid_links(classes: DataFrame, distance: int = 4, groups: int = 6) -> DataFrame:
    """Links (a, b) among classes (``fp``, ``rep``) of at most ``distance`` differing bits: in each group of
    rows that meet in a grid cell, a spanning forest of them."""
    if groups <= distance:
        raise ValueError("groups must exceed distance")
    cells = map_rows(classes, _cells(groups, distance), "cell long, rest int, fp long, rep long")
    dealt = block_pairs(cells, "fp").repartition("cell", "left", "right")
    return dealt.mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    seed: int = 42, distance: int = 4, groups: int = 6) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for every row: the smallest doc_id reachable by links of
    at most ``distance`` differing bits.

    Rows of one fingerprint collapse first, so copies never meet as pairs.  Cells that hold many
    different fingerprints are dealt in blocks.  Each group of rows sends on at most the links of
    a spanning forest.  Exact at any ``groups > distance``; more groups mean more, smaller cells,
    for larger corpora.  Null texts are empty; empty texts have fingerprint zero and are linked
    like any other; a null doc_id comes back null, its component is null if no other row has one;
    repeated rows each get a row.  An empty table gives no rows.
    """
    if groups <= distance:
        raise ValueError("groups must exceed distance")
    prints = fingerprints(docs, id_col, text_col, words, seed)
    # Two fields of one job: the grouped rows are small against the texts, and are stored once.
    from lodecat.session import cut_lineage
    prints = cut_lineage(prints)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(grid_links(classes, distance, groups))
    named = classes.join(roots, classes.rep == roots.node, "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp").select(public_id(), "fp", public_id("component_id"))
