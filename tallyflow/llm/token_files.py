"""Token ids of documents in files of compressed, checksummed blocks.

Documents are dealt out by ranges of doc_id and sorted; every part is encoded in
that order and written as chunks, each holding whole documents:

    magic, documents, blocks                                (header)
    doc_id, known, ids                                      (for each document)
    ids, payload bytes, crc32 of the ids                    (for each block)
    payloads

A block is coded from a fresh state and can be read alone. Files are Parquet with
one chunk to a row, which gives them Spark's commit protocol on any storage; the
chunk is a format of its own. What is read back comes from the chunks alone.

Words between ASCII white space are encoded once by each worker and then looked
up, if the tokenizer's file says that it ignores case and white space and never merges
across it. With any other tokenizer whole texts are encoded.

Defined results: keys are integers. Null is the empty text and has the end id only.
Null keys come first; rows with the same key follow each other in the order of their
texts. They are dealt out by the beginnings of their texts too, so one key, or
none, may have any number of rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import slices, text_bytes
from tallyflow.llm.context_coder import decode_blocks, encode_blocks

MAGIC = b"TFI3"
HEADER = struct.Struct("<4sII")
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("ids", "<u4")])
BLOCK = np.dtype([("ids", "<u4"), ("bytes", "<u4"), ("crc32", "<u4")])
BLOCK_IDS = 2048
CHUNK_IDS = 1 << 23
IN_STEP = 4096
# Words of a generation; a worker remembers two.
REMEMBERED = 400_000
# Bytes of text whose words are looked up together.
AT_ONCE = 8 << 20
# Words encoded in one text, and what stands between them.
TOGETHER = 256
SEPARATOR = "|"
Batches = Iterator[pa.RecordBatch]


# A run of these at the end of a word is a piece of its own after a letter or digit.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEFORE_MARKS = np.zeros(256, bool)
BEFORE_MARKS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
# Words of one piece that the normaliser leaves as they are.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def stems_of(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words without the marks at their end, if those are a piece of their own, and how many marks that are.

    Fewer different words are left.
    """
    short = pc.ascii_rtrim(words, characters=MARKS)
    data, at = text_bytes(short)
    own = BEFORE_MARKS[np.append(data, np.uint8(0))[at[1:] - 1]] & (at[1:] > at[:-1])
    own &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
    cut = np.diff(text_bytes(words)[1]) - np.diff(at)
    return pc.if_else(pa.array(own), short, words), np.where(own, cut, 0)


def strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def words_of(texts: list[bytes]) -> pa.ListArray:
    """The words of each text, in lower case; some may be empty.

    The tokenizer ignores case and white space; only its special tokens, which hold
    ``<|``, are told apart before that.
    """
    whole = pa.array(texts, pa.binary()).cast(pa.string())
    marked = pc.match_substring(whole, "<|")
    return pc.ascii_split_whitespace(pc.if_else(marked, whole, pc.ascii_lower(whole)))


# Normaliser and pre-tokenizer of the files that ``words_of`` and ``stems_of`` hold for.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_spaces(file: dict) -> bool:
    """Whether a tokenizer file ignores case and white space, so that words can be encoded one by one."""
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT}
    # Added tokens are looked for in the text as it is; words are not cut where one may be.
    marked = all("<|" in t["content"] for t in file.get("added_tokens") or [])
    bytewise = len(steps) == 2 and steps[1].get("type") == "ByteLevel"
    bytewise = bytewise and steps[1].get("add_prefix_space") is False and steps[1].get("use_regex") is False
    return file.get("normalizer") == NORMALIZER and split and steps[0].get("invert") is True and bytewise and marked


class Words:
    """The tokenizer, with the ids of words that a worker has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.by_words = splits_at_spaces(json.load(file))
        alone = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.by_words &= len(alone) == 1
        if self.by_words:
            # For plain words, the same without what does nothing to them.
            self.separator = alone[0]
            self.plainly = Tokenizer(self.tokenizer.model)
            self.plainly.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array([*e.ids, end], "<u4") for e in found]
        words = words_of(texts)
        coded = words.flatten().dictionary_encode()
        ids = self.ids_of(coded.dictionary).take(coded.indices)
        _, offsets, found = ids.buffers()
        ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
        stops = (np.frombuffer(offsets, np.int64, len(ids) + 1)[ends] >> 2).tolist()
        stream, last = np.frombuffer(found, "<u4", stops[-1]), np.array([end], "<u4")
        return [np.concatenate([stream[a:b], last]) for a, b in zip(stops, stops[1:])]

    def ids_of(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of different words."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        stems, cut = stems_of(words)
        coded = stems.dictionary_encode()
        ids = pa.array(self.look_up(strings(coded.dictionary)), pa.large_binary()).take(coded.indices)
        ended = np.flatnonzero(cut)
        marks = [w[-n:] for w, n in zip(strings(words.take(pa.array(ended))), cut[ended].tolist())]
        which = np.full(len(words), len(marks))
        which[ended] = np.arange(len(marks))
        tails = pa.array([*self.look_up(marks), b""], pa.large_binary()).take(pa.array(which))
        return pc.binary_join_element_wise(ids, tails, pa.scalar(b"", pa.large_binary()))

    def look_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            self.learn({words[i] for i in missing})
            for i in missing:
                found[i] = self.known[words[i]]
        return found

    def learn(self, words: set[str]) -> None:
        """Fetches words from the older generation, or encodes them."""
        again = words & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = words - again
        plain = [w for w in new if PLAIN.fullmatch(w)]
        other = list(new.difference(plain))
        self.keep(self.plainly, plain)
        self.keep(self.tokenizer, [w for w in other if w and SEPARATOR not in w])
        for w in other:
            if not w or SEPARATOR in w:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def keep(self, by, words: list[str]) -> None:
        """Encodes words, many of them in one text, between bars, which none of them has."""
        rows = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for row, e in zip(rows, by.encode_batch_fast([f" {SEPARATOR} ".join(r) for r in rows], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator) * 4
            packed = ids.tobytes()
            ends = zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(packed)], strict=True)
            self.known.update((w, packed[a:b]) for w, (a, b) in zip(row, ends, strict=True))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    return Words(path)


def pack(keys: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One chunk: documents and the blocks of their ids."""
    documents = np.zeros(len(keys), DOCUMENT)
    documents["known"] = [k is not None for k in keys]
    documents["doc_id"] = [k or 0 for k in keys]
    documents["ids"] = [len(i) for i in ids]
    stream = np.concatenate(ids)
    pieces = [stream[a : a + BLOCK_IDS] for a in range(0, len(stream), BLOCK_IDS)]
    payloads: list[bytes] = []
    for a in range(0, len(pieces), IN_STEP):
        payloads += encode_blocks(pieces[a : a + IN_STEP])
    blocks = np.zeros(len(pieces), BLOCK)
    blocks["ids"] = [len(p) for p in pieces]
    blocks["bytes"] = [len(p) for p in payloads]
    blocks["crc32"] = [zlib.crc32(p.astype("<u4", copy=False)) for p in pieces]
    head = HEADER.pack(MAGIC, len(documents), len(blocks))
    return b"".join([head, documents.tobytes(), blocks.tobytes(), *payloads])


def unpack(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and the ids of all of them; a damaged block is an error."""
    magic, n, m = HEADER.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    documents = np.frombuffer(chunk, DOCUMENT, n, HEADER.size)
    at = HEADER.size + documents.nbytes
    blocks = np.frombuffer(chunk, BLOCK, m, at)
    at += blocks.nbytes
    ends = np.cumsum(blocks["bytes"], dtype=np.int64) + at
    payloads = [chunk[b - k : b] for b, k in zip(ends.tolist(), blocks["bytes"].tolist())]
    pieces: list[np.ndarray] = []
    for a in range(0, m, IN_STEP):
        pieces += decode_blocks(payloads[a : a + IN_STEP], blocks["ids"][a : a + IN_STEP].astype(np.int64))
    for piece, crc in zip(pieces, blocks["crc32"].tolist()):
        if zlib.crc32(piece.astype("<u4", copy=False)) != crc:
            raise ValueError("a block of token ids does not match its checksum")
    return documents, np.concatenate(pieces).astype("<u4", copy=False) if pieces else np.zeros(0, "<u4")


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int = 2) -> None:
    """Writes the ids of all rows of ``docs`` (doc_id, text) to files below ``path``."""

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        words = tokenizer(tokenizer_path)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            packed = pack(keys, ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([held]), pa.array([packed], pa.binary())], ["part", "chunk", "n_ids", "ids"]
            )

        for batch in slices(batches, AT_ONCE):
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            for key, found in zip(batch["doc_id"].to_pylist(), words.encode(texts, end)):
                keys.append(key)
                ids.append(found)
                held += len(found)
                if held >= CHUNK_IDS:
                    yield chunk()
                    keys, ids, held, number = [], [], 0, number + 1
        if keys:
            yield chunk()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, 64))
    (
        ordered.sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "part long, chunk long, n_ids long, ids binary")
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below ``path``."""
    chunks = spark.read.parquet(path)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                documents, ids = unpack(batch["ids"][i].as_py())
                n = len(documents)
                ends = np.cumsum(documents["ids"], dtype=np.int64)
                starts = ends - documents["ids"]
                known = documents["known"].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch["part"][i].as_py())),
                        pa.array(np.full(n, batch["chunk"][i].as_py())),
                        pa.array(np.ascontiguousarray(documents["doc_id"]), mask=~known),
                        pa.array(starts),
                        pa.array(documents["ids"].astype(np.int64)),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    ],
                    ["part", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    found = chunks.mapInArrow(run, "part long, chunk long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Ids before a part, from one row per part; before a chunk, within its part.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before"))
        .join(parts, "part")
        .select("part", "chunk", (F.col("before_part") + F.col("before")).alias("before"))
    )
    return found.join(starts, ["part", "chunk"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
