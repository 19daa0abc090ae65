"""Quality scores by kernel ridge regression on document statistics.

Statistics of whole texts are standardised and sent through random Fourier
features, whose inner products approximate a Gaussian kernel. Ridge regression
on them needs one matrix and one vector, which every partition sums up over its
labelled rows; partial sums are added in a tree. The raw scores are calibrated by
isotonic regression on their counts in narrow bins. All labelled rows are used;
what reaches the driver does not grow with them.

Defined results: null is the empty text, which is scored like any other. Rows
with null or repeated keys are scored each on its own. Of several labels of one
key the largest counts, and labels other than 0 and 1 do not count. Without any
usable label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import Words, mixed, slices, text_bytes
from tallyflow.session import staged

NAMES = (
    "log_words", "word_bytes", "long_words", "symbols", "shouts", "bars", "capitals", "digits", "high_bytes",
    "distinct", "adjacent_repeats", "distinct_triples", "lines", "ended_words", "capital_starts", "short_words",
)
COUNTED = {
    "symbols": b"#*$%&<>",
    "shouts": b"!",
    "bars": b"|",
    "capitals": bytes(range(65, 91)),
    "small": bytes(range(97, 123)),
    "digits": bytes(range(48, 58)),
    "lines": b"\n",
}
BINS = 400
RAW_LOW, RAW_HIGH = -0.5, 1.5
PARTIAL_SUMS = 64


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    data, ends = text_bytes(column)
    words, n = Words(data, ends), len(column)
    size = np.maximum(np.diff(ends), 1)
    count = np.maximum(words.count, 1)
    owner, length = words.owner, words.stop - words.start

    def inside(letters: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(letters)] = True
        seen = np.concatenate([[0], np.cumsum(table[data])])
        return seen[ends[1:]] - seen[ends[:-1]]

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, n) / count

    def distinct(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        different = np.unique(mixed(hashes + (of.astype(np.uint64) << np.uint64(40))), return_index=True)[1]
        return np.bincount(of[different], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)

    found = {k: inside(v) for k, v in COUNTED.items()}
    h = words.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    triples, at = words.windows(3, words=h)
    first, last = data[words.start], data[np.maximum(words.stop - 1, 0)]
    letters = np.maximum(found["capitals"] + found["small"], 1)
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    return np.stack(
        [
            np.log1p(words.count),
            np.bincount(owner, length, n) / count,
            share(length > 15),
            found["symbols"] / count,
            found["shouts"] / count,
            found["bars"] / count,
            found["capitals"] / letters,
            found["digits"] / size,
            (high[ends[1:]] - high[ends[:-1]]) / size,
            distinct(h, owner),
            share(again),
            distinct(triples, owner[at]),
            found["lines"] / count,
            share(np.isin(last, list(b".!?"))),
            share((first >= 65) & (first <= 90)),
            share(length <= 2),
        ],
        1,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], listed(statistics_of(batch["text"]))], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<double>")


def listed(rows: np.ndarray) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def grid(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass
class KernelRidge:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -5, 5)
        waves = np.cos(z @ self.directions + self.phases) * (2 / len(self.phases)) ** 0.5
        return np.concatenate([waves, np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """Sum of ``part`` over all batches: within partitions, then in groups of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(batch)
                total = more if total is None else total + more
        if total is not None:
            group = TaskContext.get().partitionId() % PARTIAL_SUMS
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([total.tobytes()])], ["group", "total"])

    def add(some: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t) for t in some["total"])
        return pd.DataFrame({"group": [some["group"].iloc[0]], "total": [total.tobytes()]})

    schema = "group long, total binary"
    groups = rows.mapInArrow(run, schema).groupBy("group").applyInPandas(add, schema).toArrow()
    totals = [np.frombuffer(t) for _, t in sorted(zip(groups["group"].to_pylist(), groups["total"].to_pylist()))]
    return sum(totals) if totals else None


def train(
    stats: DataFrame, labels: DataFrame, usable: Column, waves: int = 192, width: float = 4.0, ridge: float = 1e-3, seed: int = 3
) -> KernelRidge:
    """Fits on the rows of ``stats`` with a label in ``labels`` (doc_id, quality) that are ``usable``."""
    known = labels.filter(F.col("quality").isin(0, 1) & usable).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = staged(stats.join(known, "doc_id").select("stats", "y"), "quality-train")
    dims = len(NAMES)
    rng = np.random.default_rng(seed)
    model = KernelRidge(
        np.zeros(dims), np.ones(dims), rng.normal(0, 1 / width, (dims, waves)), rng.uniform(0, 2 * np.pi, waves),
        np.zeros(waves + 1), np.zeros(0), np.zeros(0),
    )

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = grid(batch)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    found = summed(rows, moments)
    if found is None:
        return model
    n, first, second = found[0], found[1 : dims + 1], found[dims + 1 :]
    model.mean = first / n
    model.spread = np.sqrt(np.maximum(second / n - model.mean**2, 1e-6))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(grid(batch))
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch["y"].to_numpy()])

    both, size = summed(rows, equations), waves + 1
    matrix = both[: size * size].reshape(size, size)
    model.weights = np.linalg.solve(matrix + ridge * n * np.eye(size) / size, both[size * size :])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(grid(batch)), batch["y"].to_numpy()
        bins = np.clip((raw - RAW_LOW) / (RAW_HIGH - RAW_LOW) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(bins, w, BINS) for w in (np.ones(len(y)), y, raw)])

    model.knots, model.levels = isotonic(*summed(rows, histogram).reshape(3, BINS))
    return model


def isotonic(count: np.ndarray, positive: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbouring bins until the share of positives rises: mean raw scores and shares."""
    pools: list[list[float]] = []
    for c, p, r in zip(count, positive, raw):
        if c:
            pools.append([c, p, r])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([r / c for c, _, r in pools]), np.array([p / c for c, p, _ in pools])


def score(stats: DataFrame, model: KernelRidge) -> DataFrame:
    """doc_id and score of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(grid(batch)))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: KernelRidge, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(statistics_of(batch["text"])) >= least))

    return docs.mapInArrow(run, docs.schema)
