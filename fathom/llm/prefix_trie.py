"""Prefix trie of conversations, encoded by preorder intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathom.llm.common import long_id, prefix_sums
from fathom.runtime import materialize

#: Characters that stand for a turn in a path: a hash of role and text, and the text's length.
HASH, WIDTH = 22, 30
#: Nodes in one output batch, and characters of ids that are hashed at a time.
BATCH_NODES, BLOCK_CHARS = 50_000, 1 << 16
#: Bits of Spark's increasing ids that count the rows of a partition.
_ROW_BITS = 33


def turn_key(role: Column, text: Column) -> Column:
    """WIDTH characters for a turn: 132 bits of SHA-256 and the number of code points in its text."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.left(F.base64(F.unhex(F.sha2(said, 256))), F.lit(HASH)), F.lpad(F.hex(F.length(text)), WIDTH - HASH, "0"))


def keyed_turns(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, key) of each row with an id; null roles and texts are empty."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    said = rows.select(long_id(rows, id_col).alias("conv"), F.col(f"`{turn}`").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    return said.where("conv is not null").withColumn("key", turn_key(F.col("role"), F.col("text")))


def conversation_paths(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path) of each conversation in rows (id, turn, role, text): the keys of its turns in order.

    Turns are ordered by number, a null one first, turns of one number by key; a repeated row is a
    turn again. Null roles and texts count as empty. Rows without an id belong to no conversation.
    Only keys, WIDTH characters a turn, meet in a row; texts are hashed where they are read. An empty
    table gives an empty table.
    """
    keyed = keyed_turns(rows, id_col, turn, role, text).select("conv", "turn", "key")
    turns = F.sort_array(F.collect_list(F.struct("turn", "key")))
    return keyed.groupBy("conv").agg(F.array_join(F.transform(turns, lambda t: t["key"]), "").alias("path"))


def _node_of(path: Column) -> Column:
    return F.unhex(F.left(F.sha2(path, 256), F.lit(32)))


_PREFIXES = "node binary, parent binary, depth long, chars long, rank long, n long, conv long, ends long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of every path; hashes go on from one prefix to the next, so work is linear."""
    names = ["node", "parent", "depth", "chars", "rank", "n", "conv", "ends"]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6]
    out: list[list] = [[] for _ in names]

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
        for x in out:
            x.clear()
        return made

    for batch in batches:
        for i in range(batch.num_rows):
            path, n, conv, rank = (batch.column(c)[i].as_py() for c in range(4))
            state, above, depth = hashlib.sha256(), None, len(path) // WIDTH
            for d in range(depth + 1):
                key = path[(d - 1) * WIDTH : d * WIDTH] if d else ""
                state.update(key.encode())
                node = state.digest()[:16]
                for x, v in zip(out, (node, above, d, int(key[HASH:] or "0", 16), rank, n, conv, n if d == depth else 0), strict=True):
                    x.append(v)
                above = node
                if len(out[0]) >= BATCH_NODES:
                    yield flush()
    if out[0]:
        yield flush()


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(node, parent, depth, chars, conv_id, parent_conv_id, n_convs, n_ends, n_children, n_leaves,
    saved, pre, until) of every distinct prefix of ``paths`` (conv, path), from the root (depth 0).

    Distinct paths are sorted over all tasks and numbered. A node is met first in the first path
    that goes through it and last in the last, so nodes by (first path, depth) are in preorder, and
    the subtree of a node ends with the last node of its last path: ``pre`` is a node's place and
    ``until`` the place behind its subtree, so v lies under u if u.pre <= v.pre < u.until. Leaves and
    savings of a subtree are the difference of two prefix sums over that order; the sums run within
    the ranges of the sort and are based on the totals of the ranges before, one row each.

    ``conv_id`` is the smallest conversation of a node, ``parent_conv_id`` its parent's, ``n_convs`` counts
    conversations (copies too), ``n_ends`` those that end there; ``saved`` is the sum, over a subtree, of
    code points that a node's last text saves by being kept once. No conversation, no node.

    Counts are partial sums, so no first turn or copied conversation is a task's burden; a path of
    WIDTH characters a turn is the most that must fit in a row. Children that share a parent meet
    it in a join whose large partitions Spark splits.
    """
    distinct = paths.groupBy("path").agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
    ranked = distinct.repartitionByRange("path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id())
    every = ranked.select("path", "n", "conv", "rank").mapInArrow(_prefixes, _PREFIXES)
    nodes = every.groupBy("node", "parent", "depth", "chars").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("ends").alias("n_ends"))
    leaf = ((F.col("n_ends") > 0) & (F.col("first") == F.col("last"))).cast("long")
    nodes = nodes.select("*", F.shiftright("first", _ROW_BITS).alias("range"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"))
    nodes = materialize(nodes, "trie-nodes")

    summed = {"pre": F.lit(1), "leaves": F.col("leaf"), "saved": F.col("saves")}
    placed = prefix_sums(nodes, "range", ["first", "depth"], summed)
    placed = materialize(placed, "trie-order")

    ends = placed.where("n_ends > 0").select(F.col("first").alias("end"), *[F.col(name).alias(f"end_{name}") for name in summed])
    children = placed.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    parents = placed.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    wide = placed.join(ends, F.col("last") == F.col("end")).join(children, F.col("node") == F.col("of"), "left").join(parents, F.col("parent") == F.col("above"), "left")
    return wide.select(
        "node", "parent", "depth", "chars", "conv_id", "parent_conv_id", "n_convs", "n_ends",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("saved") + F.col("saves")).alias("saved"),
        (F.col("pre") - 1).alias("pre"), F.col("end_pre").alias("until"),
    )


def ends_of(paths: DataFrame) -> DataFrame:
    """(node, conv) of each conversation: the node that it ends at."""
    return paths.select(_node_of(F.col("path")).alias("node"), "conv")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of comma-joined ids, of one node each, from rows in order."""
    node, start, ids, size, out = None, 0, [], 0, []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist([dict(zip(("node", "start", "ids"), x, strict=True)) for x in out], pa.schema([("node", pa.binary()), ("start", pa.int64()), ("ids", pa.string())]))
        out.clear()
        return made

    for batch in batches:
        for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != node or size >= BLOCK_CHARS:
                if ids:
                    out.append((node, start, ",".join(ids)))
                node, start, ids, size = at, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) >= 1000:
            yield flush()
    if ids:
        out.append((node, start, ",".join(ids)))
    if out:
        yield flush()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of each node, which come in order; only its state is held."""
    node, state = None, None
    for batch in batches:
        nodes, sums = [], []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if at != node:
                if state is not None:
                    nodes.append(node)
                    sums.append(state.hexdigest())
                node, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending and
    comma-joined; nodes where none ends have no row.

    Ids are sorted over all tasks by node and id, so those of a node lie in several tasks if they are
    many; each task joins runs of them to blocks, and a node's blocks go through one hash in order.
    """
    sorted_ = ends_of(paths).repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    blocks = sorted_.mapInArrow(_pack, "node binary, start long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "start").mapInArrow(_digest, "node binary, ends_sha256 string")


def conversation_trie(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``prefix_trie`` of the conversations in rows (id, turn, role, text). Nulls, ties, repeated rows
    and empty tables are as in ``conversation_paths``; other columns play no part."""
    return prefix_trie(materialize(conversation_paths(rows, id_col, turn, role, text), "paths"))
