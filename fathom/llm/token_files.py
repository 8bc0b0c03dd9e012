"""Token ids as flat binary files with 64-bit document offsets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathom.llm.common import give_back, long_id
from fathom.runtime import materialize, new_path

MANIFEST = "part int, n_docs long, n_ids long, width int"

#: Bytes of words and ids that a worker remembers, in two generations of this size; all else is encoded
#: anew. With BLOCK_CHARS this is what a worker's memory follows; a caller may set both.
REMEMBERED = 64_000_000
#: Rows, and characters of texts, that are taken apart at a time, and new words in one call of the library.
BATCH_ROWS, BLOCK_CHARS, CALL_WORDS = 2_000, 6_000_000, 5_000
#: Marks a text's first word, which no space and no newline precedes.
_FIRST = "\x01"
#: White space that doesn't stand alone between words, or isn't a space or a newline; the mark.
_ODD = r"^ | $|  | \n|\n |\n\n|[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_PUNCTUATION = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: A run of letters, which is one piece, and what punctuation may close.
_LETTERS, _CLOSED = re.compile(f"[{_LATIN}]+"), f"[0-9{_LATIN}]$"


class Letters(dict):
    """What a byte-level vocabulary writes for each character."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = "".join(x for x, _ in self.level.pre_tokenize_str(chr(code)))
        return self[code]


def _gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat``, of ``sizes``, in the order of their numbers ``at``; and where each then ends."""
    first, wide = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(wide)
    place = np.repeat(first[at] - ends + wide, wide)
    place += np.arange(len(place))
    return flat[place], ends


class Memory:
    """Ids by word, bounded in bytes: what two generations haven't asked for is forgotten."""

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        ids = self.young.get(word)
        if ids is None and (ids := self.old.get(word)) is not None:
            self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.size += len(word) + len(ids) + 200  # what the two objects and the table take besides
        if self.size >= self.most:
            self.young, self.old, self.size = {}, self.young, 0


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` of many texts, with a bounded memory.

    A byte-level BPE encodes a text piece by piece. A space or newline between two characters that
    aren't white space always begins a piece, and so does ASCII punctuation that closes a word
    behind a letter or digit. So the distinct words of a block of texts, with what precedes and
    without what closes them, are encoded once, unknown ones many in one call with newlines between,
    and the ids of the texts are gathered from them. Texts that this doesn't hold for, and
    vocabularies of another make, take the library's way one by one.
    """

    def __init__(self, path: str, width: int | None = None, remembered: int = REMEMBERED, block_chars: int = BLOCK_CHARS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.block_chars = block_chars

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width or width_of(self.tokenizer.get_vocab_size(True))
        self.dtype = np.dtype(f"<u{self.width}")
        self.memory = Memory(remembered)
        self.newline = np.frombuffer(self._whole("\n"), dtype=self.dtype)
        self.by_word = self._by_word(path) and len(self.newline) == 1
        self.letters, self.bare = Letters(), Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(self.letters[ord("\n")], "isolated")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([_ODD, *special])

    @staticmethod
    def _by_word(path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in made.get("added_tokens") or [])
        return plain and not odd and model.get("type") == "BPE" and not made.get("normalizer") and not model.get("dropout")

    def _whole(self, text: str) -> bytes:
        (made,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(made.ids, dtype=self.dtype).tobytes()

    def _parts(self, tokenizer, joined: str) -> list[bytes]:
        """Ids of what newlines separate in a text, from one call."""
        (made,) = tokenizer.encode_batch_fast([joined], add_special_tokens=False)
        ids, w = np.array(made.ids, dtype=self.dtype), self.width
        ends = (np.flatnonzero(ids == self.newline[0]) * w).tolist()
        whole = ids.tobytes()
        return [whole[x:y] for x, y in zip([0, *[e + w for e in ends]], [*ends, len(whole)], strict=True)]

    def _new(self, stems: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of stems that aren't remembered. Runs of letters are one piece each, so the model takes
        them as they are; the others go through the library as lines."""
        plain, other = [], []
        for x in stems:
            (plain if _LETTERS.fullmatch(x, x[0] == _FIRST) else other).append(x)
        for words, run in ((plain, self._pieces), (other, lambda lines: self._parts(self.tokenizer, "\n".join(lines)))):
            for x in range(0, len(words), CALL_WORDS):
                part = words[x : x + CALL_WORDS]
                yield from zip(part, run([w[1:] if w[0] == _FIRST else " " + w for w in part]), strict=True)

    def _pieces(self, lines: list[str]) -> list[bytes]:
        return self._parts(self.bare, "\n".join(lines).translate(self.letters))

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of distinct words without what closes them; a mark stands before a line's first."""
        memory, known, missing = self.memory, [], []
        for n, x in enumerate(stems):
            ids = memory.get(x) if x != _FIRST else b""
            known.append(ids)
            if ids is None:
                missing.append(n)
        if missing:
            at = dict(zip([stems[n] for n in missing], missing, strict=True))
            for x, ids in self._new(list(at)):
                known[at[x]] = ids
                memory.put(x, ids)
        return known

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, in a row, and how many each has: a mark or a newline and a first
        word, or a word behind a space."""
        line = pc.starts_with(words, "\n")
        stems = pc.ascii_rtrim(words, _PUNCTUATION)
        stems = pc.if_else(pc.match_substring_regex(stems, _CLOSED), stems, words)
        cut = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        stems = pc.if_else(line, pc.binary_replace_slice(stems, 0, 1, _FIRST), stems).dictionary_encode()
        line = line.to_numpy(zero_copy_only=False)
        pieces = self._stems(stems.dictionary.to_pylist())
        closed = np.flatnonzero(cut < pc.binary_length(words).to_numpy(zero_copy_only=False))
        # three pieces a word: a newline or nothing, its stem, and what closes it or nothing
        table = np.full((len(words), 3), len(pieces), dtype=np.int64)
        table[line, 0] = len(pieces) + 1
        table[:, 1] = stems.indices.to_numpy(zero_copy_only=False)
        pieces += [b"", self.newline.tobytes()]
        tails: dict[str, int] = {}
        for n, w, x in zip(closed.tolist(), words.take(pa.array(closed)).cast(pa.large_binary()).to_pylist(), cut[closed].tolist(), strict=True):
            tail = w[x:]
            if tail not in tails:
                tails[tail] = len(pieces)
                pieces.append(self._whole(tail.decode()))
            table[n, 2] = tails[tail]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // self.width
        ids, _ = _gather(np.frombuffer(b"".join(pieces), dtype=self.dtype), sizes, table.ravel())
        return ids, sizes[table].sum(axis=1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little endian."""
        out: list[bytes] = []
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= self.block_chars:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        column = pa.array(texts, pa.large_string())
        odd = pc.or_(pc.match_substring_regex(column, self.odd), pc.equal(column, "")).to_numpy(zero_copy_only=False)
        plain = pa.array([_FIRST + texts[i].replace("\n", " \n") for i in np.flatnonzero(~odd).tolist()], pa.large_string())
        lists = pc.split_pattern(plain, " ")
        named = lists.values.dictionary_encode()
        ids, ends = _gather(*self._words(named.dictionary), named.indices.to_numpy(zero_copy_only=False))
        ids, ends = ids.tobytes(), np.concatenate(([0], ends)) * self.width
        ends = ends[lists.offsets.to_numpy()].tolist()
        parts = iter([ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
        return [self._whole(t) if o else next(parts) for t, o in zip(texts, odd.tolist(), strict=True)]


def width_of(vocabulary: int) -> int:
    """Bytes of an id: 2 where every id fits, else 4."""
    return 2 if vocabulary <= 1 << 16 else 4


_encoders: dict[tuple, Encoder] = {}


def _encoder(*settings: object) -> Encoder:
    if settings not in _encoders:
        _encoders.clear()
        _encoders[settings] = Encoder(*settings)
    return _encoders[settings]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(where: pafs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    """Write under another name, then rename: a reader sees a whole file, whoever wrote it last."""
    own = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as file:
        for c in chunks:
            file.write(c)
    where.move(own, path)


def _writer(folder: str, path: str, end_id: int, width: int, id_col: str, text: str, remembered: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, end = _encoder(path, width, remembered, block_chars), np.array([end_id], dtype=f"<u{width}").tobytes()
        where, root = _open(folder)
        where.create_dir(root, recursive=True)
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        sizes: list[int] = []
        own = f"{root}/{part:06d}.bin.{uuid.uuid4().hex}"
        with where.open_output_stream(own) as file:
            for batch in batches:
                names = batch.schema.names
                keys = batch.column(names.index(id_col))
                ids.append((keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), keys.is_null().to_numpy(zero_copy_only=False)))
                texts = batch.column(names.index(text)).fill_null("")
                for x in range(0, len(texts), BATCH_ROWS):
                    for made in encoder.encode(texts.slice(x, BATCH_ROWS).to_pylist()):
                        file.write(made + end)
                        sizes.append(len(made) // width + 1)
        give_back()
        if not sizes:
            where.delete_file(own)
            return
        where.move(own, f"{root}/{part:06d}.bin")
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, dtype="<i8")))).astype("<i8")
        _put(where, f"{root}/{part:06d}.idx", iter([offsets.tobytes()]))
        _put(where, f"{root}/{part:06d}.doc", iter([np.concatenate([k for k, _ in ids]).tobytes(), np.concatenate([n for _, n in ids]).tobytes()]))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(sizes)]), "n_ids": pa.array([int(offsets[-1])]), "width": pa.array([width], pa.int32())})

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = 2, remembered: int = REMEMBERED, block_chars: int = BLOCK_CHARS) -> tuple[str, DataFrame]:
    """Encode every text and write the ids in ascending ``id_col`` order; (folder, manifest).

    Rows are dealt out by ranges of the id, so that files in the order of their numbers hold the
    documents in the order of their ids. A task writes one file of ids (.bin: unsigned, little
    endian, 2 bytes where the vocabulary fits, else 4), one of offsets (.idx: 64-bit, one more than
    documents) and one of document ids (.doc: 64-bit, then a byte each that says if the id is
    null), each under a name of its own attempt first, so a task that is run again or twice leaves
    one whole file. The manifest (part, n_docs, n_ids, width, base) has one row a file; base is the
    number of ids in all files before, by prefix sums.

    ``folder`` must be shared by the executors and is made under spark.checkpoint.dir if not given.
    ``tokenizer`` is a path that every executor has. ``end_id`` follows each document. ``remembered`` and
    ``block_chars`` bound what a worker holds, never what comes out. A null text
    counts as empty. Ids are integers; a null id comes first. Repeated ids stay next to each other, by text. Empty
    tables make no file and an empty manifest.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = (folder or new_path(spark, "tokens")).rstrip("/")
    width = width_of(max(Tokenizer.from_file(tokenizer).get_vocab_size(True), end_id + 1))
    rows = docs.select(long_id(docs, id_col).alias("__id"), F.col(f"`{text}`").alias("__text"))
    rows = rows.repartitionByRange(F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first(), F.col("__text").asc_nulls_first())
    made = materialize(rows.mapInArrow(_writer(folder, tokenizer, end_id, width, "__id", "__text", remembered, block_chars), MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder, spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _bytes(where: pafs.FileSystem, path: str) -> memoryview:
    """Mapped into memory where the file lies on a local disk, else read."""
    if isinstance(where, pafs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return memoryview(file.read_buffer())
    with where.open_input_file(path) as file:
        return memoryview(file.read())


def read_file(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, which are null, offsets, token ids) of one file."""
    where, root = _open(folder)
    tokens = np.frombuffer(_bytes(where, f"{root}/{part:06d}.bin"), dtype=f"<u{width}")
    offsets = np.frombuffer(_bytes(where, f"{root}/{part:06d}.idx"), dtype="<i8")
    doc, n = _bytes(where, f"{root}/{part:06d}.doc"), len(offsets) - 1
    return np.frombuffer(doc[: 8 * n], dtype="<i8"), np.frombuffer(doc[8 * n :], dtype=bool), offsets, tokens


#: Ids in one output batch of a reader.
BATCH_IDS = 2_000_000


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, ids) of each document in a folder of token files; start counts the ids of all
    documents before it."""
    return _read(spark, folder, id_col, lambda ids: pa.array(ids, pa.list_(pa.int64())), "ids array<long>", "ids")


def token_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files. The checksum is that of
    the ids as 32-bit numbers. Null and repeated ids come out as they were written, null and empty
    texts with the end id alone; a folder without files gives an empty table."""
    import zlib

    def crc(ids: list[np.ndarray]) -> pa.Array:
        return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())

    return _read(spark, folder, id_col, crc, "ids_crc32 long", "ids_crc32")


def _read(spark: SparkSession, folder: str, id_col: str, of, column: str, name: str) -> DataFrame:
    manifest = spark.read.parquet(f"{folder}/manifest")
    manifest = manifest.repartitionByRange(max(1, manifest.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, null, offsets, tokens = read_file(folder, row["part"], row["width"])
                at = 0
                while at < len(doc):
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_IDS, side="right")) - 1)
                    each = [tokens[a:b] for a, b in zip(offsets[at:to].tolist(), offsets[at + 1 : to + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[at:to], mask=null[at:to]), pa.array(offsets[at:to] + row["base"]), pa.array(np.diff(offsets[at : to + 1])), of(each)], names=[id_col, "start", "n_tokens", name])
                    at = to

    return manifest.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, {column}")
