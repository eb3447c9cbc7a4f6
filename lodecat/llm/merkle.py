"""Merkle manifest of a data set as a persistent tree with path copying (12).

Rows are leaves; the leaves of a group ascend by id, and every two consecutive nodes, or one left
over, become one node, until the group has one.  The group roots are the leaves of one more tree.

Nodes lie in aligned blocks of 4096: a block is one task's work, twelve levels high, and its top is a
leaf of the next storey of blocks, so a tree of any size takes as many Spark passes as it has storeys.
A changed leaf makes a new version of the tree, which shares every untouched node with the base:
inside its block only the ancestors of the leaf are copied, and above it the version goes on with
the path of its block, so versions are spread over the tasks of their blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodecat.llm.common import lookup
from lodecat.operators.order import global_positions
from lodecat.session import cut_lineage

#: Leaves of a block, 2 ** LEVELS.
LEVELS = 12
BLOCK = 1 << LEVELS
_ALONE, _LEFT, _RIGHT = b"-", b"<", b">"


def node(*children: bytes) -> bytes:
    """The digest of a run of one or two nodes, as hex text."""
    return sha256(b"".join(children)).hexdigest().encode()


def height(nodes: int) -> int:
    """Levels of a block above its leaves, where the whole tree has so many nodes at that storey."""
    return LEVELS if nodes > BLOCK else (nodes - 1).bit_length()


def storeys(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """All nodes of one block, leaves first."""
    out = [leaves]
    for _ in range(levels):
        now = out[-1]
        out.append([node(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return out


def path(tree: list[list[bytes]], at: int) -> bytes:
    """Siblings of a leaf, level by level: a mark of the sibling's side, and the sibling if there is one."""
    out = []
    for row in tree[:-1]:
        other = at ^ 1
        out.append((_LEFT if at & 1 else _RIGHT) + row[other] if other < len(row) else _ALONE)
        at >>= 1
    return b"".join(out)


def steps(siblings: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling) for each level of a path."""
    out, at = [], 0
    while at < len(siblings):
        end = at + (1 if siblings[at:at + 1] == _ALONE else 65)
        out.append((siblings[at:at + 1], siblings[at + 1:end]))
        at = end
    return out


def copied(leaf: bytes, siblings: bytes) -> list[bytes]:
    """The nodes that a version with this leaf does not share with the base: the leaf's ancestors."""
    out = []
    for side, other in steps(siblings):
        leaf = node(leaf) if side == _ALONE else node(other, leaf) if side == _LEFT else node(leaf, other)
        out.append(leaf)
    return out


def proof(siblings: bytes) -> str:
    return node(*[s for _, s in steps(siblings)]).decode()


def field(column: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows.column("pos").to_numpy(), kind="stable")))


def _tree(rows: pa.Table) -> list[list[bytes]]:
    """The nodes of a block, from its leaves in order."""
    return storeys([h.encode() for h in rows.column("h").to_pylist()], height(rows.column("n")[0].as_py()))


def _top(rows: pa.Table) -> pa.Table:
    """One row of a block: its top, a leaf of the next storey."""
    rows = _in_order(rows)
    tree, pos, n = (rows.column(c)[0].as_py() for c in ("tree", "pos", "n"))
    return pa.table({"tree": [tree], "pos": [pos // BLOCK], "n": [-(-n // BLOCK)], "h": [_tree(rows)[-1][0].decode()]})


def _block() -> Column:
    return F.shiftright("pos", LEVELS).alias("block")


def _climb(leaves: DataFrame) -> list[DataFrame]:
    """Storeys of nodes (tree, pos, n, h), leaves first, until every tree has one node."""
    out = [leaves]
    while True:
        now = out[-1].withColumn("block", _block()).groupBy("tree", "block")
        tops = cut_lineage(now.applyInArrow(_top, "tree long, pos long, n long, h string"))
        out.append(tops)
        if not (tops.agg(F.max("n")).first()[0] or 0) > 1:
            return out


def _below(nodes: DataFrame, above: DataFrame | None, each: Callable[[pa.Table, list[str]], pa.Table], schema: str) -> DataFrame:
    """Every node of a storey with its siblings up to the top of its tree; ``each`` makes rows of them.

    ``above`` has (tree, pos, path) of the next storey; none: blocks are whole trees.
    """
    def with_paths(rows: pa.Table, up: bytes) -> pa.Table:
        rows = _in_order(rows)
        tree = _tree(rows)
        return each(rows, [path(tree, k) + up for k in range(rows.num_rows)])
    grouped = nodes.withColumn("block", _block()).groupBy("tree", "block")
    if above is None:
        return grouped.applyInArrow(lambda rows: with_paths(rows, b""), schema)
    other = above.select("tree", F.col("pos").alias("block"), "path").groupBy("tree", "block")
    return grouped.cogroup(other).applyInArrow(lambda rows, up: with_paths(rows, up.column("path")[0].as_py()), schema)


def _paths(rows: pa.Table, siblings: list[bytes]) -> pa.Table:
    return pa.table({"tree": rows.column("tree"), "pos": rows.column("pos"), "path": pa.array(siblings, pa.binary())})


def _descend(nodes: list[DataFrame]) -> DataFrame | None:
    """(tree, pos, path) of the tops of the lowest blocks, or none if those are the roots."""
    up = None
    for storey in reversed(nodes[1:-1]):
        up = cut_lineage(_below(storey, up, _paths, "tree long, pos long, path binary"))
    return up


@dataclass
class Manifest:
    """A built tree.  ``leaves``: id, own, changed, tree, pos, n, h.  ``roots``: tree, subroot, path (from the
    group's root up), so ``many`` rows.  ``root``: the root of all, none for an empty table."""

    leaves: DataFrame
    upper: DataFrame | None
    roots: DataFrame
    many: int
    root: str | None

    def _versions(self, each, schema: str) -> DataFrame:
        """``each(rows, siblings)`` over the leaves of each block, with siblings up to the root of all."""
        if self.upper is None:
            over = self.roots.select("tree", F.lit(0).cast("long").alias("pos"), "path")
        else:
            over = self.upper.join(lookup(self.roots.select("tree", F.col("path").alias("above")), self.many), "tree").select("tree", "pos", F.concat("path", "above").alias("path"))
        return _below(self.leaves, over, each, schema)

    def proofs(self) -> DataFrame:
        """``doc_id``, ``tree``, ``leaf``, ``proof_sha256``, ``folded_root``, ``verified`` of every row: the root of its version
        (its changed leaf where it has one, else the base) from the original siblings."""
        root = self.root

        def each(rows: pa.Table, siblings: list[bytes]) -> pa.Table:
            own = [c if c is not None else h for c, h in zip(rows.column("changed").to_pylist(), rows.column("h").to_pylist())]
            folded = [(copied(h.encode(), s) or [h.encode()])[-1].decode() for h, s in zip(own, siblings)]
            return pa.table({"doc_id": rows.column("doc_id"), "tree": rows.column("tree"), "leaf": rows.column("h"),
                             "proof_sha256": [proof(s) for s in siblings], "folded_root": folded, "verified": [f == root for f in folded]})
        return self._versions(each, "doc_id long, tree long, leaf string, proof_sha256 string, folded_root string, verified boolean")

    def copies(self) -> DataFrame:
        """``doc_id``, ``tree``, ``pos``, ``level``, ``h``: the nodes that each version copies, level 0 the changed leaf.
        Levels count on from the group's root into the tree of groups; every other node is the base's."""
        def each(rows: pa.Table, siblings: list[bytes]) -> pa.Table:
            out = {c: [] for c in ("doc_id", "tree", "pos", "level", "h")}
            for i, t, p, c, s in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "tree", "pos", "changed")), siblings):
                for level, h in enumerate([c.encode(), *copied(c.encode(), s)] if c is not None else []):
                    for name, value in zip(out, (i, t, p, level, h.decode())):
                        out[name].append(value)
            return pa.table(out, pa.schema([("doc_id", pa.int64()), ("tree", pa.int64()), ("pos", pa.int64()), ("level", pa.int32()), ("h", pa.string())]))
        return self._versions(each, "doc_id long, tree long, pos long, level int, h string")


def build(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves``: doc_id, grp (string), h, changed (the leaf's other digest, or null).

    Leaves of a group ascend by doc_id, null first; rows that share an id ascend by digest.  Groups ascend by
    their bytes, null first.  One more pass numbers the groups, which may be many.
    """
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("changed")]
    placed = global_positions(leaves.select("doc_id", "grp", "h", "changed"), order, "place")
    sizes = cut_lineage(placed.groupBy("grp").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    groups = global_positions(sizes, [F.asc("first")], "tree").withColumn("tree", F.col("tree") - 1)
    many = sizes.count()
    own = placed.join(lookup(groups.select(F.col("grp").alias("g"), "tree", "first", "n"), many), F.col("grp").eqNullSafe(F.col("g")))
    rows = cut_lineage(own.select("doc_id", "changed", "tree", (F.col("place") - F.col("first")).alias("pos"), "n", "h"))
    nodes = _climb(rows.select("tree", "pos", "n", "h"))
    named = nodes[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(many).cast("long").alias("n"), "h")
    over = _climb(named)
    top = over[-1].select("h").first()
    ways = _below(over[0], _descend(over), _paths, "tree long, pos long, path binary")
    roots = cut_lineage(ways.select(F.col("pos").alias("tree"), "path").join(nodes[-1].select("tree", F.col("h").alias("subroot")), "tree"))
    return Manifest(rows, _descend(nodes), roots, many, top and top[0])


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``documents``, grouped by lang.  Where 7 divides the crc32 of the decimal doc_id, one is
    added to n_chars, which gives the changed leaf; a null id or a null n_chars changes nothing.  Other columns go."""
    columns = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    bumped = [*columns[:3], columns[3] + 1, columns[4]]
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    return build(docs.select(columns[0].alias("doc_id"), F.col("lang").alias("grp"), leaf_of(*columns).alias("h"),
                             F.when(hit & F.col("n_chars").isNotNull(), leaf_of(*bumped)).alias("changed")))


def verify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row.

    Nulls stand as ``-`` in a leaf, empty texts as ``0:``; repeated rows are leaves of their own, a table of one
    row has itself as root and an empty proof; an empty table gives no rows.
    """
    built = manifest(docs)
    return built.proofs().join(lookup(built.roots.select("tree", "subroot"), built.many), "tree").select(
        "doc_id", "leaf", "subroot", F.lit(built.root).alias("root"), "proof_sha256", "folded_root", "verified")
