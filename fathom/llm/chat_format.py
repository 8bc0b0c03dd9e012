"""Chat formatting: conversations as one depth-first sequence in which shared turns stand once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fathom.llm.common import prefix_sums
from fathom.llm.prefix_trie import conversation_paths, ends_of, keyed_turns, prefix_trie
from fathom.runtime import materialize, new_path

#: What stands before and behind a turn, by role; other roles are named in their marks.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER = ("<|", "|>", "<|end|>")
#: Strings that only marks may hold: <s> </s> <<SYS>> <</SYS>> [INST] [/INST] <| |>. In texts
#: their first character gets a backslash behind it, and a backslash is doubled.
CONTROL = r"(<(?=/?s>|</?SYS>>|\|)|\[(?=/?INST\])|\|(?=>))"
#: Whose texts are learnt.
LEARNT = "assistant"

#: Nodes, and characters of the sequence, that are worked through in one go.
PART_NODES, PART_CHARS = 50_000, 1 << 22


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def parse_turn(written: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    for role, (head, foot) in MARKS.items():
        if written.startswith(head):
            return role, unescape(written[len(head) : len(written) - len(foot)])
    start, middle, foot = OTHER
    role, _, text = written[len(start) :].partition(middle)
    return unescape(role), unescape(text[: len(text) - len(foot)])


def split_turns(formatted: str) -> list[str]:
    """The formatted turns of a whole conversation. A text holds no mark and no mark's end is its
    start, so each turn ends with the first closing mark behind its opening one."""
    turns = []
    while formatted:
        head, foot = next(((h, f) for h, f in MARKS.values() if formatted.startswith(h)), (OTHER[0], OTHER[2]))
        end = formatted.index(foot, len(head)) + len(foot)
        turns.append(formatted[:end])
        formatted = formatted[end:]
    return turns


def _marked(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """What stands before a turn's text, the text without control strings, and what stands behind."""
    before = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    behind = F.lit(OTHER[2])
    for name, (head, foot) in MARKS.items():
        before = F.when(role == name, head).otherwise(before)
        behind = F.when(role == name, foot).otherwise(behind)
    return before, escape(text), behind


_tokenizers: dict[str, object] = {}


def _encoder(path: str):
    """For mapInArrow over turns: their token ids, of the marks and the text one by one, so that the
    learnt part is whole tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            from tokenizers import Tokenizer

            _tokenizers.clear()
            _tokenizers[path] = Tokenizer.from_file(path)
        encode = _tokenizers[path].encode_batch_fast
        for batch in batches:
            texts, head, body = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("text", "head", "body"))
            parts = [x for t, h, b in zip(texts, head, body, strict=True) for x in (t[:h], t[h : h + b], t[h + b :])]
            made = [e.ids for e in encode(parts, add_special_tokens=False)]
            each = [made[i : i + 3] for i in range(0, len(made), 3)]
            ids = pa.array([a + b + c for a, b, c in each], pa.list_(pa.int32()))
            first, last = pa.array([len(a) for a, _, _ in each], pa.int32()), pa.array([len(a) + len(b) for a, b, _ in each], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, first, last], names=[*batch.schema.names, "ids", "ids_from", "ids_to"])

    return run


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, members) of the conversations in rows (id, turn, role, text).

    Conversations are merged in a prefix tree, whose turns are the segments of one sequence over the
    whole table, depth first, so that a turn which conversations share from their start on is written
    once. ``segments`` has (pre, depth, start, position, until, text, loss_from, loss_to, n_ends): the
    number of the turn's node, where its text starts in the sequence, the position id of its first
    character in its conversations (ids run on from there), where its subtree ends, the formatted
    turn, the learnt part of it (null: none) and how many conversations end with it. Tokens are code
    points; with ``tokenizer``, a file of the tokenizers library that every executor has, they are its
    ids, and segments also have (ids, ids_from, ids_to): a turn's ids and the learnt part of them. A token attends to what stands before it in a segment with start <= its place < until:
    those are its own turn and its ancestors, so one interval a segment says all of the mask. Where
    depth is 1 a tree starts, and no interval crosses from one to the next; a loader may cut there,
    or anywhere else if it repeats the segments whose interval the cut lies in.

    ``members`` has (conv_id, pre): the node that each conversation ends with.

    Starts are prefix sums over the preorder, positions the same less what has been left on the way,
    so a tree may be any part of the data. The text of a node is that of the smallest conversation
    through it. Turns are ordered as in ``conversation_paths``; null roles and texts count as empty,
    a repeated row is a turn again, rows without an id don't count, and no rows give no segments.
    """
    paths = materialize(conversation_paths(rows, id_col, turn, role, text), "paths")
    trie = prefix_trie(paths).where("depth > 0")
    trie = materialize(trie.select("node", "depth", "conv_id", "n_ends", "pre", "until"), "trie")

    turns = keyed_turns(rows, id_col, turn, role, text)
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "key"))
    turns = turns.select("conv", place.cast("long").alias("place"), "role", *[c.alias(n) for n, c in zip(("before", "said", "behind"), _marked(F.col("role"), F.col("text")), strict=True)])
    said = trie.join(turns, (F.col("conv_id") == F.col("conv")) & (F.col("depth") == F.col("place")))
    learnt = F.col("role") == LEARNT
    loss = [F.when(learnt, F.length("before")).alias("loss_from"), F.when(learnt, F.length("before") + F.length("said")).alias("loss_to")]
    whole = F.concat("before", "said", "behind")
    said = said.select("depth", "pre", "until", "n_ends", whole.alias("text"), F.length("before").alias("head"), F.length("said").alias("body"), learnt.alias("learnt"), *loss)
    more = []
    if tokenizer:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in said.schema)
        said = said.mapInArrow(_encoder(tokenizer), f"{kinds}, ids array<int>, ids_from int, ids_to int")
        more = ["ids", *[F.when(F.col("learnt"), F.col(c)).alias(c) for c in ("ids_from", "ids_to")]]
    size = F.size("ids") if tokenizer else F.length("text")
    said = materialize(said.select("depth", "pre", "until", "n_ends", "text", size.cast("long").alias("chars"), "loss_from", "loss_to", *more), "turns")

    sizes = said.select("pre", "until", "chars", F.floor(F.col("pre") / PART_NODES).alias("part"))
    left = sizes.groupBy(F.col("until").alias("at")).agg(F.sum("chars").alias("left"))
    steps = sizes.join(left, F.col("pre") == F.col("at"), "left").select("pre", "until", "chars", "part", F.coalesce("left", F.lit(0)).alias("left"))
    sums = prefix_sums(steps, "part", ["pre"], {"upto": F.col("chars"), "gone": F.col("left")})
    sums = materialize(sums.select("pre", "until", (F.col("upto") - F.col("chars")).alias("start"), (F.col("upto") - F.col("chars") - F.col("gone")).alias("position")), "places")
    total = sums.groupBy().agg(F.max("until").alias("n")).select("n").scalar()
    length = said.agg(F.sum("chars").alias("n")).select("n").scalar()
    nexts = sums.select(F.col("pre").alias("at"), F.col("start").alias("end"))
    sums = sums.join(nexts, F.col("until") == F.col("at"), "left")
    sums = sums.select(F.col("pre").alias("number"), "start", "position", F.when(F.col("until") == total, length).otherwise(F.col("end")).alias("ends_at"))
    segments = said.join(sums, F.col("pre") == F.col("number"))
    segments = segments.select("pre", "depth", "start", "position", F.col("ends_at").alias("until"), "text", "loss_from", "loss_to", "n_ends", *(["ids", "ids_from", "ids_to"] if tokenizer else []))
    ends = ends_of(paths).withColumnRenamed("node", "at")
    members = ends.join(trie.select("node", "pre"), F.col("at") == F.col("node")).select(F.col("conv").alias("conv_id"), "pre")
    return segments, members


def write_conversations(rows: DataFrame, folder: str | None = None, **settings: str) -> str:
    """Write what ``format_conversations`` makes of ``rows`` as two Parquet tables, segments in the order
    of the sequence, to a folder (a new one under spark.checkpoint.dir if not given); its path."""
    folder = (folder or new_path(rows.sparkSession, "chat")).rstrip("/")
    segments, members = format_conversations(rows, **settings)
    segments.repartitionByRange("start").sortWithinPartitions("start").write.mode("overwrite").parquet(f"{folder}/segments")
    members.write.mode("overwrite").parquet(f"{folder}/members")
    return folder


class _Turns:
    """What has been said from a conversation's start on: two hash states and three counts."""

    def __init__(self, before: _Turns | None, until: int, text: str, loss: tuple[int | None, int | None]):
        self.until = until
        self.said = before.said.copy() if before else hashlib.sha256()
        self.learnt = before.learnt.copy() if before else hashlib.sha256()
        self.turns, self.chars, self.loss = (before.turns, before.chars, before.loss) if before else (0, 0, 0)
        role, plain = parse_turn(text)
        self.said.update(f"{role}\n{plain}\n".encode())
        self.turns += 1
        self.chars += len(text)
        if loss[0] is not None:
            part = unescape(text[loss[0] : loss[1]])
            self.learnt.update(part.encode())
            self.loss += len(part)


_READ = "pre long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's segments in order, behind those that reach into it from before, on a stack."""
    part, stack = None, []
    names = [c.split(" ")[0] for c in _READ.split(", ")]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["part"] != part:
                part, stack = r["part"], []
            while stack and stack[-1].until <= r["start"]:
                stack.pop()
            stack.append(now := _Turns(stack[-1] if stack else None, r["until"], r["text"], (r["loss_from"], r["loss_to"])))
            if r["own"] and r["n_ends"]:
                out.append((r["pre"], now.turns, now.said.hexdigest(), now.loss, now.learnt.hexdigest(), now.chars))
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))


def conversation_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation,
    read back from a folder of ``write_conversations``.

    The sequence is read in parts of PART_CHARS; segments whose interval reaches into later parts
    go to those too, at most one a level of the tree and part. A part is a scan with a stack, whose
    hash states go on from turn to turn, so texts aren't joined. Conversations find what is read of
    their last turn by its number; copies are far apart until then. No segments, no rows.
    """
    segments = spark.read.parquet(f"{folder}/segments")
    part = lambda c: F.floor(c / PART_CHARS)
    first, last = part(F.col("start")), part(F.greatest(F.col("start"), F.col("until") - 1))
    spread = segments.select("*", F.explode(F.sequence(first, F.greatest(first, last))).alias("part")).withColumn("own", F.col("part") == first)
    spread = spread.select("part", "start", "until", "pre", "text", "loss_from", "loss_to", "n_ends", "own")
    read = spread.repartition("part").sortWithinPartitions("part", "start").mapInArrow(_read, _READ)
    members = spark.read.parquet(f"{folder}/members").withColumnRenamed("pre", "at")
    return members.join(read, F.col("at") == F.col("pre")).select("conv_id", *[c.split(" ")[0] for c in _READ.split(", ")[1:]])
