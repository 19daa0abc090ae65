"""What the corpus operators share: words and their hashes in numpy, batches, row keys."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import staged

# Words are what stands between these six bytes: [^\x20\x09-\x0D]+.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACES = bytes([0x20, *range(0x09, 0x0E)])

SLICE_BYTES = 4 << 20
HASHED_BYTES = 1 << 20
PLACE_BITS = 33

_SEED = np.random.default_rng(20240)
_BYTE_VALUE = _SEED.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; the value 0 stands in for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def on_storage(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows are picked from Parquet files as they lie there, else a written copy."""
    plan = docs._jdf.queryExecution().analyzed()
    settled = plan.deterministic()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if settled and plan.nodeName() == "LogicalRelation" and plan.relation().toString() == "parquet":
        return docs
    return staged(docs, "documents")


def numbered(docs: DataFrame, *columns: str, name: str = "row") -> DataFrame:
    """The named columns with ``row``, a number for each row, which ``name`` renames.

    The number is the place of a row on storage: its file's place among the sorted
    files of the table, and its place in the file. It does not depend on how a read
    is split, so a second read, with more or fewer executors, gives the same numbers.
    Two calls agree if ``docs`` has been through ``on_storage`` before both.
    """
    docs = on_storage(docs)
    place = docs.metadataColumn("_metadata")
    paths = docs.select(place["file_path"].alias("path")).distinct().collect()  # reads no column but those of a filter
    files = [(path, i) for i, path in enumerate(sorted(r["path"] for r in paths))]
    known = docs.sparkSession.createDataFrame(files, "_file string, _number long")
    # A list of files fits any executor; a shuffle instead would move all texts.
    found = docs.select(place["file_path"].alias("_path"), place["row_index"].alias("_index"), *[F.col(c).alias(f"_of_{c}") for c in columns]).join(
        F.broadcast(known), F.col("_path") == F.col("_file"), "left"
    )
    number = F.coalesce("_number", F.raise_error(F.concat(F.lit("a file that the table does not list: "), "_path")).cast("long"))
    return found.select((F.shiftleft(number, PLACE_BITS) + F.col("_index")).alias(name), *[F.col(f"_of_{c}").alias(c) for c in columns])


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that no table needs any more.

    Spark deletes them once its driver has collected the plans as garbage. A job of
    several written stages would else hold the shuffles of all of them on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(rows: int, per_partition: int, least: int) -> int:
    """Partitions so that each holds about so many rows."""
    return max(least, -(-rows // per_partition))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that their ``text`` column has about ``limit`` bytes.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        ends = offsets(column)[1:].astype(np.int64)
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else offsets(column)[0]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, min(stop, n) - start)
            start = stop


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each starts and ends. Null has none."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = offsets(column).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """All words of a batch of texts.

    ``start`` and ``stop`` are byte positions, ``first[d]`` is the number of the
    first word of text ``d``; ``first`` has one more entry for the end.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = data
        solid = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = solid[1:] != solid[:-1]
        edge[ends] = True
        cut = np.flatnonzero(edge)
        if len(data):
            keep = solid[cut[:-1]]
            self.start, self.stop = cut[:-1][keep], cut[1:][keep]
        else:
            self.start = self.stop = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, ends)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(ends) - 1), self.count)
        self._solid = solid

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, then mixed.

        Worked out for some words at a time, as it needs several integers a byte.
        """
        size = self.stop - self.start
        out = np.empty(len(size), np.uint64)
        if not len(size):
            return out
        powers = np.full(int(size.max()), _BASE[which], np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        ends = np.cumsum(size)
        a = 0
        while a < len(size):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + HASHED_BYTES, side="right")))
            at = ends[a:b] - size[a:b] - before
            span = slice(int(self.start[a]), int(self.stop[b - 1]))
            letters = self.data[span][self._solid[span]]
            place = np.arange(len(letters), dtype=np.int64) - np.repeat(at, size[a:b])
            out[a:b] = np.add.reduceat(_BYTE_VALUE[which][letters] * powers[place], at)
            a = b
        return mixed(out + size.astype(np.uint64))

    def windows(self, length: int, which: int = 0, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``length`` words, and the number of its first word."""
        h = self.hashes(which) if words is None else words
        if len(h) < length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = np.flatnonzero(self.owner[: len(h) - length + 1] == self.owner[length - 1 :])
        return rolled(h, length, which)[start], start


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` entries, from the hashes of the entries."""
    n = len(h) - length + 1
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * _BASE[1 - which] + h[i : i + n]
    return mixed(total)
