"""Repeated passages by level-wise doubling of window lengths: 5, 10, then 20 words.

A window of 20 words that occurs twice has windows of 5 and of 10 words that occur
twice. So each level counts only what the level before has found repeated, and a
document leaves as soon as nothing of it survives; most leave after the first.

* 5 words: of the 16 windows of 5 words in a window of 20, the one with the
  smallest hash is its anchor. Equal windows have equal anchors, so anchors stand
  for all windows at about an eighth of their number.
* 10 words: a repeated anchor is doubled to the left and to the right.
* 20 words: a window is counted if its anchor's doubling on the side that lies
  inside it is repeated. Its first occurrence, by doc_id and start, stays; words
  under any later one are removed.

Windows meet in fragments, ranges of their hash. What repeats within a batch is
settled there: only the first of it travels on, so a passage in a third of all
documents reaches its fragment once per batch. At the last level windows are
compared by 96 bits of hash.

``docs`` is read twice; rows are known by their place on storage, whatever the
splits of a read. A row that does not match its answers ends the job.

Defined results: null has no words. Rows with the same doc_id are one document
for the order of occurrences, and no occurrence is earlier than another with the
same doc_id and start; a null doc_id comes before all others. Keys are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import Words, numbered, on_storage, rolled, slices, text_bytes
from tallyflow.session import staged

BASE, LENGTH = 5, 20
GRAMS = LENGTH - BASE + 1
NO_KEY = -(1 << 63)
PLACE = np.uint64((1 << 24) - 1)
# Windows whose anchors are found at once; their places, counted from the first, fit PLACE.
RUN = 1 << 22
SCHEMA = "part long, row long, doc_id long, text string, marks binary"
ENTRY = np.dtype([("token", "<u8"), ("more", "<u4"), ("row", "<i8"), ("doc_id", "<i8"), ("start", "<i4"), ("count", "u1")])
MARK = np.dtype([("row", "<i8"), ("start", "<i4")])
Batches = Iterator[pa.RecordBatch]


class Sequence:
    """Word hashes of a batch, with its anchors."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, self.ends = text_bytes(batch["text"])
        self.words = Words(self.data, self.ends)
        self.h = self.words.hashes()
        self.rows = batch["row"].to_numpy()
        self.keys = batch["doc_id"].fill_null(NO_KEY).to_numpy()
        owner = self.words.owner
        n = len(owner) - LENGTH + 1
        self.windows = np.flatnonzero(owner[:n] == owner[LENGTH - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.grams = rolled(self.h, BASE) if len(self.h) >= BASE else np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """For each window of 20 words, the place of its window of 5 with the smallest hash."""
        n = max(0, len(self.grams) - GRAMS + 1)
        anchor = np.empty(n, np.int64)
        for a in range(0, n, RUN):
            b = min(a + RUN, n)
            grams = self.grams[a : b + GRAMS - 1]
            low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
            step = 1
            while step < GRAMS:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            anchor[a:b] = (low & PLACE).astype(np.int64) + a
        return anchor[self.windows]

    def marked(self, marks: pa.Array) -> np.ndarray:
        """Places of the starts that ``marks`` holds for each text."""
        starts = [np.frombuffer(m.as_buffer(), "<i4") if m.is_valid else np.zeros(0, "<i4") for m in marks]
        if not starts:
            return np.zeros(0, np.int64)
        return np.concatenate(starts).astype(np.int64) + np.repeat(self.words.first[:-1], [len(s) for s in starts])

    def entries(self, places: np.ndarray, tokens: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(places), ENTRY)
        owner = self.words.owner[places]
        out["token"], out["row"], out["doc_id"] = tokens, self.rows[owner], self.keys[owner]
        out["start"], out["count"] = places - self.words.first[owner], 1
        if more is not None:
            out["more"] = more
        return out


def level_5(seq: Sequence, marks: pa.Array) -> np.ndarray:
    anchors = np.unique(seq.anchors())
    return seq.entries(anchors, seq.grams[anchors])


def level_10(seq: Sequence, marks: pa.Array) -> np.ndarray:
    anchors = seq.marked(marks)
    owner = seq.words.owner[anchors]
    left = anchors[anchors - BASE >= seq.words.first[owner]] - BASE
    right = anchors[anchors + 2 * BASE <= seq.words.first[owner + 1]]
    places = np.unique(np.concatenate([left, right]))
    return seq.entries(places, rolled(seq.h, 2 * BASE)[places] if len(places) else np.zeros(0, np.uint64))


def level_20(seq: Sequence, marks: pa.Array) -> np.ndarray:
    repeated = np.zeros(len(seq.h) + 1, bool)
    repeated[seq.marked(marks)] = True
    anchor = seq.anchors()
    inner = np.where(anchor - seq.windows >= BASE, anchor - BASE, anchor)
    places = seq.windows[repeated[inner]]
    if not len(places):
        return seq.entries(places, np.zeros(0, np.uint64))
    more = rolled(seq.words.hashes(1), LENGTH, 1)[places] >> np.uint64(32)
    return seq.entries(places, rolled(seq.h, LENGTH)[places], more)


def runs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by window and occurrence, and the number of each one's window."""
    entries = entries[np.lexsort((entries["start"], entries["doc_id"], entries["more"], entries["token"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["token"][1:] != entries["token"][:-1]) | (entries["more"][1:] != entries["more"][:-1])
    return entries, np.cumsum(new) - 1


def any_repeated(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries to send on, and entries known to be repeated and not known before."""
    entries, group = runs(entries)
    total = np.bincount(group, entries["count"]) if len(group) else np.zeros(0)
    found = (total[group] > 1) & (entries["count"] == 1)
    first = np.searchsorted(group, np.arange(len(total)))
    sent = entries[first]
    sent["count"] = np.minimum(total, 2)
    return sent, entries[found]


def later_ones(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences that may be the first, and those that are later than another."""
    entries, group = runs(entries)
    first = entries[np.searchsorted(group, group)]
    later = (entries["doc_id"] != first["doc_id"]) | (entries["start"] != first["start"])
    return entries[~later], entries[later]


def bucket(rows: np.ndarray, buckets: int) -> np.ndarray:
    return ((rows >> 33) * 31 + (rows & ((1 << 33) - 1))) % buckets


def blobs(parts: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
    """One row for each part with its share of ``content``."""
    order = np.argsort(parts, kind="stable")
    parts, content = parts[order], content[order]
    cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]])) if len(parts) else np.zeros(1, int)
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(parts[cuts[:-1]] if n else [], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()),
            pa.array([content[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        ],
        ["part", "row", "doc_id", "text", "marks"],
    )


def answers(found: np.ndarray, buckets: int, shift: int = 0) -> pa.RecordBatch:
    marks = np.zeros(len(found), MARK)
    marks["row"], marks["start"] = found["row"], found["start"]
    marks = marks[np.argsort(marks, order=("row", "start"))]
    return blobs(bucket(marks["row"], buckets) + shift, marks)


def grouped(batches: Batches) -> Iterator[tuple[int, Iterator[tuple]]]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch["part"].to_pylist(), batch["row"].to_pylist(), batch["doc_id"], batch["text"], batch["marks"])

    return groupby(rows(), key=itemgetter(0))


def deal(level: Callable, settle: Callable, fragments: int, buckets: int) -> Callable[[Batches], Batches]:
    """Windows of a level to their fragments; parts from ``fragments`` on are buckets of documents."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 8 << 20):
            sent, found = settle(level(Sequence(batch), batch["marks"]))
            yield blobs((sent["token"] % np.uint64(fragments)).astype(np.int64), sent)
            yield answers(found, buckets, fragments)

    return run


def resolve(settle: Callable, fragments: int, buckets: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for part, rows in grouped(batches):
            if part < fragments:
                entries = np.concatenate([np.frombuffer(r[4].as_buffer(), ENTRY) for r in rows])
                yield answers(settle(entries)[1], buckets)
            else:
                for r in rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part - fragments]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([r[4].as_py()], pa.binary())],
                        ["part", "row", "doc_id", "text", "marks"],
                    )

    return run


def absorb(last: bool) -> Callable[[Batches], Batches]:
    """Joins texts with what was found in them; texts without anything found are done."""

    def run(batches: Batches) -> Batches:
        for _, rows in grouped(batches):
            texts, found = [], []
            for _, row, doc_id, text, marks in rows:
                if row is None:
                    found.append(np.frombuffer(marks.as_buffer(), MARK))
                else:
                    texts.append((row, doc_id.as_py(), text))
            marks = np.unique(np.concatenate(found)) if found else np.zeros(0, MARK)
            texts.sort(key=itemgetter(0))
            numbers = np.array([t[0] for t in texts], np.int64)
            if len(np.setdiff1d(marks["row"], numbers)):
                raise ValueError("rows changed places between two reads: write the table first")
            first, stop = np.searchsorted(marks["row"], numbers), np.searchsorted(marks["row"], numbers, side="right")
            out = []
            for (row, doc_id, text), a, b in zip(texts, first, stop):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                starts = marks["start"][a:b]
                if last or a == b:
                    out.append((row, doc_id, *without(body, starts), None, None))
                else:
                    out.append((row, doc_id, None, None, None, body, starts.tobytes()))
            for at in range(0, len(out), 500):
                columns = list(zip(*out[at : at + 500]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                arrays[5] = arrays[5].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_words", "n_removed", "kept_sha256", "text", "marks"])

    return run


def without(body: bytes, starts: np.ndarray) -> tuple[int, int, str]:
    """Words, removed words and digest of the words that no window from ``starts`` covers."""
    words = body.split()
    if not len(starts):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    if starts[-1] + LENGTH > len(words):
        raise ValueError("a text changed between two reads: write the table first")
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LENGTH, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    digest = hashlib.sha256(b" ".join([words[i] for i in kept.tolist()])).hexdigest()
    return len(words), len(words) - len(kept), digest


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    docs = on_storage(docs)
    left = numbered(docs, "doc_id", "text").select("row", F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("marks"))
    size = docs.select(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(48, size >> 22)
    results = []
    for level, settle in ((level_5, any_repeated), (level_10, any_repeated), (level_20, later_ones)):
        last = level is level_20
        fragments = max(64, size >> 21)
        home = F.pmod(F.shiftright("row", 33) * 31 + F.col("row").bitwiseAND((1 << 33) - 1), F.lit(buckets))
        texts = left.select(home.cast("long").alias("part"), "row", "doc_id", "text", F.lit(None).cast("binary").alias("marks"))
        told = (
            left.mapInArrow(deal(level, settle, fragments, buckets), SCHEMA)
            .repartition("part")
            .sortWithinPartitions("part")
            .mapInArrow(resolve(settle, fragments, buckets), SCHEMA)
        )
        done = staged(
            told.unionByName(texts)
            .repartition("part")
            .sortWithinPartitions("part")
            .mapInArrow(absorb(last), "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, text string, marks binary"),
            "repeats",
        )
        results.append(done.filter(F.col("n_words").isNotNull()).select("doc_id", "n_words", "n_removed", "kept_sha256"))
        left = done.filter(F.col("n_words").isNull()).select("row", "doc_id", "text", "marks")
        if last or left.isEmpty():
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
