"""Merkle manifest of a document table by incremental witnesses.

A leaf is the SHA-256 of a row's fields.  The leaves of a source stand in doc_id
order under a tree of FANOUT children a node, the sources' roots in source order
under one more tree of the same form.

* Leaves are *appended* in order to an aligned block of BLOCK of them.  Every open
  subtree carries the partial witnesses of its leaves; when its run of siblings is
  complete, each member's witness is extended by the run's other digests and all
  move up into the next open subtree (``Appender``).
* Blocks are built in parallel.  Their roots are *further appends* one level up,
  again in aligned blocks, until a source has one root; the sources' roots are
  appended last.  What an append above adds to a block root's witness extends the
  witnesses of all leaves below it.
* A row's place among its source's leaves comes from a range partitioning on
  (source, doc_id) and the counts of its parts, so a source of a third of all rows is
  spread like any other, and no task holds more than one block at a time.

Documents move as two digests; their text is hashed where it is read.

Defined results: a null field enters a leaf as ``-``; null sources are a source of
their own, the first; a null doc_id stands first in its source and is never
tampered with; rows that share source and doc_id stand in the order of their
leaves; an empty table gives no rows; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clickwise.llm.common import UPPER, materialise

FANOUT = 16
# Levels of a tree that one task builds; a block is FANOUT ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 3
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5

Piece = tuple[str, str]  # the digests left and right of a node in its run


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Appender:
    """One block: open subtrees by level, each with its children so far and, per child,
    the leaves below it.  ``witness[i]`` grows from the leaf upwards."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.open: list[list[tuple[str, list[int]]]] = [[]]
        self.witness: list[list[Piece]] = []

    def append(self, node: str) -> None:
        self.witness.append([])
        self._add(0, node, [len(self.witness) - 1])

    def _add(self, level: int, node: str, members: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, members))
        if len(self.open[level]) == self.fanout:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for i, (_, members) in enumerate(run):
            piece = ("".join(nodes[:i]), "".join(nodes[i + 1:]))
            for m in members:
                self.witness[m].append(piece)
        self._add(level + 1, digest("".join(nodes)), [m for _, members in run for m in members])

    def close(self, levels: int) -> str:
        """Complete what is open below ``levels`` (the last runs are shorter); the root."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def fold(node: str, witness: list[Piece]) -> str:
    """The root that ``node`` and its witness lead to."""
    for left, right in witness:
        node = digest(left + node + right)
    return node


def _packed(witness: list[Piece]) -> str:
    return "/".join(f"{left},{right}" for left, right in witness)


def _unpacked(text: str) -> list[Piece]:
    return [tuple(piece.split(",")) for piece in text.split("/")] if text else []


def _built(nodes: list[str], n: int, fanout: int, block: int) -> tuple[str, list[list[Piece]]]:
    """Root and witnesses of one block of a group of ``n`` nodes."""
    app = Appender(fanout)
    for node in nodes:
        app.append(node)
    return app.close(depth(min(n, block), fanout)), app.witness


NODES = "grp string, pos long, n long, node string"


def _block_roots(table: pa.Table, fanout: int, block: int) -> pa.Table:
    table = table.sort_by("pos")
    grp, pos, n = (table.column(c)[0].as_py() for c in ("grp", "pos", "n"))
    root, _ = _built(table.column("node").to_pylist(), n, fanout, block)
    return pa.table({"grp": [grp], "pos": pa.array([pos // block], pa.int64()), "n": pa.array([-(-n // block)], pa.int64()), "node": [root]})


def _extended(table: pa.Table, above: pa.Table, fanout: int, block: int) -> pa.Table:
    """The block's nodes with their whole witnesses: their own, then that of the block's root."""
    table = table.sort_by("pos")
    _, witness = _built(table.column("node").to_pylist(), table.column("n")[0].as_py(), fanout, block)
    outer, top, root = (above.column(c)[0].as_py() for c in ("witness", "top", "root"))
    rest = [outer] if outer else []
    size = len(witness)
    return pa.table({"grp": table.column("grp"), "pos": table.column("pos"), "node": table.column("node"),
                     "witness": pa.array(["/".join(([_packed(w)] if w else []) + rest) for w in witness], pa.string()),
                     "top": pa.array([top] * size, pa.string()), "root": pa.array([root] * size, pa.string())})


RESULT = ("doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def _proved(table: pa.Table, above: pa.Table, fanout: int, block: int) -> pa.Table:
    """The manifest's rows of one block of leaves: witnesses are completed, hashed and
    folded here and never leave the task."""
    table = table.sort_by("pos")
    leaves = table.column("node").to_pylist()
    _, witness = _built(leaves, table.column("n")[0].as_py(), fanout, block)
    outer, top, root = (above.column(c)[0].as_py() for c in ("witness", "top", "root"))
    rest = _unpacked(outer)
    rest_text = "".join(left + right for left, right in rest)
    proof, folded = [], []
    for leaf, changed, w in zip(leaves, table.column("tampered").to_pylist(), witness):
        proof.append(digest("".join(left + right for left, right in w) + rest_text))
        folded.append(fold(changed or leaf, w + rest))
    size = len(leaves)
    return pa.table({"doc_id": table.column("doc_id"), "source": table.column("source"), "leaf": table.column("node"),
                     "subroot": pa.array([top] * size, pa.string()), "root": pa.array([root] * size, pa.string()),
                     "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()),
                     "verified": pa.array([f == root for f in folded], pa.bool_())})


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, with the number of rows of the group before them in this partition."""
    last, seen = None, 0
    for batch in batches:
        grp = batch.column("grp").to_pandas().to_numpy()
        if not len(grp):
            continue
        start = np.r_[0, np.flatnonzero(grp[1:] != grp[:-1]) + 1]
        run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(grp)]))
        at = np.arange(len(grp), dtype=np.int64) - start[run]
        if grp[0] == last:
            at[run == 0] += seen
        last, seen = grp[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])


def positions(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` (with a string ``grp``) plus ``pos``, the place in its group by ``order``, and
    ``n``, the group's size; and the largest size.  One shuffle by ranges of (grp, order)."""
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", at long"
    local = materialise(ranged.mapInArrow(_numbered, schema))
    # One row per part and group in it: at most the number of parts plus that of groups.
    counts = local.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))
    by = W.partitionBy("grp").orderBy("part")
    starts = materialise(counts.select("grp", "part", (F.sum("c").over(by) - F.col("c")).alias("start"),
                                       F.sum("c").over(W.partitionBy("grp")).alias("n")))
    most = starts.agg(F.max("n")).first()[0] or 0
    return (local.join(starts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("start")).drop("at", "start", "part"), most)


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {block}"))


def _climb(leaves: DataFrame, most: int, fanout: int, block: int) -> list[DataFrame]:
    """The appends, one table a round: ``leaves``, their block roots, ... up to one root a group."""
    tables = [leaves]
    while True:
        tables.append(_in_blocks(tables[-1], block).select("grp", "block", "pos", "n", "node").groupBy("grp", "block")
                      .applyInArrow(lambda t: _block_roots(t, fanout, block), NODES))
        if most <= block:
            return tables
        most = -(-most // block)


def _descend(tables: list[DataFrame], above: DataFrame, fanout: int, block: int) -> DataFrame:
    """``above`` (grp, pos, witness, top, root of the groups' roots) brought down to the
    nodes of ``tables[0]``, each table's witnesses extended by those over it."""
    for nodes in reversed(tables):
        left = _in_blocks(nodes, block).select("grp", "block", "pos", "n", "node").groupBy("grp", "block")
        right = above.select("grp", F.col("pos").alias("block"), "witness", "top", "root").groupBy("grp", "block")
        above = left.cogroup(right).applyInArrow(lambda t, a: _extended(t, a, fanout, block),
                                                 "grp string, pos long, node string, witness string, top string, root string")
    return above


def leaf(text: Column, **fields: Column) -> Column:
    """H of the leaf's fields: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for name in LEAF_FIELDS:
        value = text if name == "text" else fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified per row of ``docs``."""
    block = fanout ** block_levels
    fields = {c: F.col(c) for c in LEAF_FIELDS if c != "text"}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        # Null first, and apart from the empty name.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("grp"),
        leaf(F.col("text"), **fields).alias("node"),
        F.when(changed, leaf(F.translate("text", UPPER, UPPER.lower()), **fields)).alias("tampered"))
    leaves, most = positions(rows, "doc_id", "node")
    tables = _climb(leaves, most, fanout, block)
    subroots = materialise(tables[-1].select("grp", "node"))  # one row per source
    ranked, n_sources = positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source_key"), "node"), "source_key")
    over = _climb(ranked, n_sources, fanout, block)
    top = over[-1].select("grp", "pos", F.lit("").alias("witness"), F.col("node").alias("top"), F.col("node").alias("root"))
    # A source's root, with its witness among the sources, is what its own appends go on from.
    found = _descend(over[:-1], top, fanout, block)
    above = (ranked.join(found.select("pos", "witness", "root"), "pos")
                   .select(F.col("source_key").alias("grp"), F.lit(0).cast("long").alias("pos"), "witness", F.col("node").alias("top"), "root"))
    if len(tables) > 2:
        above = _descend(tables[1:-1], above, fanout, block)
    left = _in_blocks(leaves, block).groupBy("grp", "block")
    right = above.select("grp", F.col("pos").alias("block"), "witness", "top", "root").groupBy("grp", "block")
    return left.cogroup(right).applyInArrow(lambda t, a: _proved(t, a, fanout, block), RESULT)
