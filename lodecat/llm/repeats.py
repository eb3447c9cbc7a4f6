"""Repeats across documents through an anchored, enhanced suffix array (8).

Every window of ``length`` bytes has one anchor, its least 16-byte gram, so equal windows have
equal anchors wherever they stand.  The windows of one anchor form a context.  Contexts meet by
their anchor; of equal contexts one stands for all.  Where the contexts of an anchor differ, their
suffixes are sorted, their common prefixes measured, and the tree of common-prefix intervals is
scanned with a stack.  An interval is a maximal repeat if the bytes before its suffixes differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodecat.llm.common import longs, map_rows, public_id, texts
from lodecat.session import run_folder

GRAM = 16
_CHUNK = 1 << 20
_LOW = np.uint64((1 << 22) - 1)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def contexts(raw: bytes, length: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, first window, last window) of each context of one text.

    A context is the run of windows with one anchor; its bytes are ``raw[first:last + length]``.
    """
    none = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows, span = len(raw) - length + 1, length - GRAM + 1
    if windows <= 0:
        return none
    parts = []
    for begin in range(0, windows, _CHUNK):
        last = min(begin + _CHUNK, windows)
        g = np.frombuffer(raw, np.uint8, last - begin + length - 1, begin).astype(_U)
        for step in (1, 2, 4):
            g = g[:-step] | (g[step:] << _U(8 * step))
        gram = _mix(_mix(g[:-8] * _U(0x9E3779B97F4A7C15)) + g[8:])
        least, width = (gram & ~_LOW) | np.arange(len(gram), dtype=_U), 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        anchor = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        final = np.r_[first[1:], len(anchor)] - 1
        at = anchor[first]
        size = final + length - first
        # The grams at every 16th byte and the last one cover the whole context.
        whole = _mix(size.astype(_U) + gram[first + size - GRAM])
        for k in range(0, 2 * length - GRAM, GRAM):
            inside = k + GRAM <= size
            whole = np.where(inside, _mix(whole * _U(0x9E3779B97F4A7C15) + gram[np.where(inside, first + k, first)]), whole)
        parts.append((gram[at], whole, first + begin, final + begin))
    return tuple(np.concatenate(p) for p in zip(*parts))


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, common length) of every common-prefix interval of at least ``least``.

    ``lcp[i]`` is between suffix i and the one before it; ``lcp[0]`` is ignored.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (common length, first suffix)
    for i, k in enumerate([*lcp[1:].tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > k:
            common, first = stack.pop()
            out.append((first, i - 1, common))
        if k >= least and (not stack or stack[-1][0] < k):
            stack.append((k, first))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def maximal_groups(parts: list[bytes], anchor: np.ndarray, length: int = 50):
    """(group, length, part, offset) of the maximal repeats among contexts, all occurrences.

    Suffixes of contexts with different anchors can share no window and stay apart.  A context's
    first suffix has no known byte before it and counts as different from all.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    reach = int(sizes.max())
    part = np.repeat(np.arange(len(parts)), sizes - length + 1)
    begins = np.cumsum(sizes) - sizes
    offset = np.arange(len(part)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    buf = np.frombuffer(b"".join(parts) + bytes(reach), np.uint8)
    left = sizes[part] - offset
    suffix = np.lib.stride_tricks.sliding_window_view(buf, reach)[begins[part] + offset].copy()
    suffix[np.arange(reach) >= left[:, None]] = 0
    order = np.argsort(suffix.view(f"S{reach}").ravel(), kind="stable")
    suffix, part, offset, left = suffix[order], part[order], offset[order], left[order]
    differ = suffix[1:] != suffix[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), reach)
    lcp = np.r_[0, np.minimum(lcp, np.minimum(left[1:], left[:-1]))]
    lcp[1:][anchor[part[1:]] != anchor[part[:-1]]] = 0
    a, b, common = intervals(lcp, length)
    if not len(a):
        return (np.zeros(0, np.int64),) * 4
    before = np.where(offset > 0, buf[np.maximum(begins[part] + offset - 1, 0)].astype(np.int64), -1)
    change = np.cumsum(np.r_[False, (before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)])
    diverse = change[b] > change[a]
    a, b, common = a[diverse], b[diverse], common[diverse]
    n = b - a + 1
    group = np.repeat(np.arange(len(a)), n)
    member = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    return group, common[group], part[member], offset[member]


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int):
    """Tables of whole anchors, of about ``rows`` rows, from rows sorted by anchor."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _chunk_groups(table: pa.Table, length: int):
    return maximal_groups(table.column("ctx").to_pylist(), table.column("h").to_numpy(), length)


def maximal_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repeat_id, length, doc_id, start``: the maximal repeats of at least ``length`` bytes that
    documents share, with all occurrences.

    Lengths reach to the end of the anchor's context; longer passages come as overlapping repeats.
    """
    def whole(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"h": [], "doc_id": [], "start": [], "ctx": []}
        for d, t in zip(longs(batch, "doc_id").tolist(), batch.column("text").to_pylist()):
            raw = t.encode()
            h, _, first, last = contexts(raw, length)
            out["h"].append(h.view(np.int64))
            out["doc_id"].append(np.full(len(h), d, np.int64))
            out["start"].append(first)
            out["ctx"] += [raw[a:b + length] for a, b in zip(first.tolist(), last.tolist())]
        return {k: pa.array(np.concatenate(v)) if k != "ctx" else pa.array(v, pa.binary()) for k, v in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_chunks(batches, 5000):
            group, common, part, offset = _chunk_groups(table, length)
            if len(group):
                h = table.column("h").to_numpy()[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_mix(h.view(_U) + group.astype(_U)).view(np.int64)), pa.array(common.astype(np.int32)),
                     pa.array(table.column("doc_id").to_numpy()[part]), pa.array(table.column("start").to_numpy()[part] + offset)],
                    ["repeat_id", "length", "doc_id", "start"])
    rows = map_rows(texts(docs, id_col, text_col), whole, "h long, doc_id long, start long, ctx binary")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(
        run, "repeat_id long, length int, doc_id long, start long").select("repeat_id", "length", public_id(), "start")


def _meet(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, c, full``: contexts whose anchor other documents share.

    ``full``: a smaller document has the same context.  The others are the first of their context
    among several of one anchor; their suffixes decide.
    """
    def rows(batch: pa.RecordBatch) -> dict:
        h_all, c_all, d_all = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for d, t in zip(longs(batch, "doc_id").tolist(), batch.column("text").to_pylist()):
            h, c, _, _ = contexts(t.encode(), length)
            c, at = np.unique(c, return_index=True)
            h_all.append(h[at])
            c_all.append(c)
            d_all.append(np.full(len(at), d, np.int64))
        return {"h": np.concatenate(h_all).view(np.int64), "c": np.concatenate(c_all).view(np.int64), "doc_id": np.concatenate(d_all)}
    own, same = Window.partitionBy("h"), Window.partitionBy("h", "c")
    seen = (map_rows(docs, rows, "h long, c long, doc_id long").repartition("h")
            .withColumn("first", F.min("doc_id").over(same))
            .select("doc_id", "c", (F.col("doc_id") > F.col("first")).alias("full"),
                    F.min("c").over(own).alias("c0"), F.max("c").over(own).alias("c1"),
                    F.min("doc_id").over(own).alias("d0"), F.max("doc_id").over(own).alias("d1")))
    return seen.filter("full or (c0 < c1 and d0 < d1)").select("doc_id", "c", "full")


def _suffix_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _in_chunks(batches, 5000):
            doc, c = table.column("doc_id").to_numpy(), table.column("c").to_numpy()
            group, common, part, offset = _chunk_groups(table, length)
            if not len(group):
                continue
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            first = np.minimum.reduceat(doc[part], begin)[group]
            late = doc[part] > first
            part, offset, common = part[late], offset[late], common[late]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[part]), pa.array(c[part]), pa.array(offset.astype(np.int32)), pa.array((offset + common).astype(np.int32))],
                ["doc_id", "c", "a", "b"])
    return run


def removed_spans(raw: bytes, full: np.ndarray, part_c: np.ndarray, part_a: np.ndarray, part_b: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged byte spans of one text from its marked contexts."""
    _, c, first, last = contexts(raw, length)
    c = c.view(np.int64)
    whole = np.isin(c, full)
    starts, ends = [first[whole]], [last[whole] + length]
    if len(part_c):
        order = np.argsort(part_c, kind="stable")
        part_c, part_a, part_b = part_c[order], part_a[order], part_b[order]
        lo, hi = np.searchsorted(part_c, c, "left"), np.searchsorted(part_c, c, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        starts.append(np.repeat(first, n) + part_a[at])
        ends.append(np.repeat(first, n) + part_b[at])
    a, b = np.concatenate(starts), np.concatenate(ends)
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.r_[new[1:], len(a)] - 1].tolist()))


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, the ``kept`` bytes.

    A byte goes if a string of ``length`` bytes over it also starts in a document of smaller id,
    judged on the input.  Null texts are empty; rows that share an id take nothing from each other
    but both lose what smaller ids have; a null id counts as the smallest and stays null; every
    row gives a row; an empty table gives none.  The shared contexts are a written table in the
    shared folder, so a lost executor costs no earlier step.
    """
    spark, own = docs.sparkSession, texts(docs, id_col, text_col)
    place = run_folder(spark, "shared-contexts")
    _meet(own, length).write.parquet(place)
    marked = spark.read.parquet(place)
    asked = marked.filter("not full").groupBy("doc_id").agg(F.collect_list("c").alias("asked"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"h": [], "doc_id": [], "c": [], "ctx": []}
        for d, t, want in zip(longs(batch, "doc_id").tolist(), batch.column("text").to_pylist(), batch.column("asked")):
            raw = t.encode()
            h, c, first, last = contexts(raw, length)
            own_c, at = np.unique(c.view(np.int64), return_index=True)
            at = at[np.isin(own_c, want.values.to_numpy())]
            h, c, first, last = h[at], c[at], first[at], last[at]
            out["h"] += h.view(np.int64).tolist()
            out["doc_id"] += [d] * len(at)
            out["ctx"] += [raw[a:b + length] for a, b in zip(first.tolist(), last.tolist())]
            out["c"] += c.view(np.int64).tolist()
        return {k: pa.array(v, pa.binary() if k == "ctx" else pa.int64()) for k, v in out.items()}
    pieces = map_rows(own.join(asked, "doc_id"), cut, "h long, doc_id long, c long, ctx binary")
    spans = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(_suffix_spans(length), "doc_id long, c long, a int, b int")
    whole = F.lit(None).cast("int")
    marks = (marked.filter("full").select("doc_id", "c", whole.alias("a"), whole.alias("b")).union(spans)
             .groupBy("doc_id").agg(F.collect_list(F.struct("c", "a", "b")).alias("marks")))

    def finish(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for t, m in zip(batch.column("text").to_pylist(), batch.column("marks")):
            raw = t.encode()
            gone: list[tuple[int, int]] = []
            if m.is_valid and len(m.values):
                c, a, b = (m.values.field(k) for k in ("c", "a", "b"))
                full = a.is_null().to_numpy(zero_copy_only=False)
                c = c.to_numpy()
                a, b = (x.fill_null(0).to_numpy().astype(np.int64) for x in (a, b))
                gone = removed_spans(raw, c[full], c[~full], a[~full], b[~full], length)
            left, at = [], 0
            for x, y in gone:
                left.append(raw[at:x])
                at = y
            rest = b"".join([*left, raw[at:]])
            for k, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(rest)), ("n_spans", len(gone)),
                         ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept", rest)):
                out[k].append(v)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return {"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items() if kept or k != "kept"}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    done = map_rows(own.join(marks, "doc_id", "left"), finish, schema)
    return done.select(public_id(), *done.columns[1:])
