"""Language of whole texts by a small byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum, and a softmax layer turns the maxima into
probabilities. The network is trained in numpy on a bounded sample of labelled
rows; every window of every text is then scored in its partition, and a text's
probabilities are the mean over its windows by their bytes.

Defined results: a null text, and one without any letter, is ``und`` with score
0; so is every text if no language can be learned. Rows with a null or repeated
key are predicted like any other, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import slices, text_bytes
from tallyflow.session import staged

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteConvNet:
    languages: list[str]
    embedding: np.ndarray  # 256 x e
    filters: list[np.ndarray]  # per width: width x e x filters
    bias: np.ndarray  # all filters
    dense: np.ndarray  # all filters x languages
    dense_bias: np.ndarray


def windows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into zero-padded windows: windows, their text, their bytes."""
    data, ends = text_bytes(column)
    size = np.diff(ends)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    order = np.arange(len(owner)) - first[owner]
    filled = np.minimum(size[owner] - order * WINDOW, WINDOW)
    grid = np.zeros(len(owner) * WINDOW, np.uint8)
    shift = first * WINDOW - ends[:-1]
    grid[np.arange(len(data)) + np.repeat(shift, size)] = data
    return grid.reshape(-1, WINDOW), owner, filled


def learn(
    grids: np.ndarray,
    labels: np.ndarray,
    languages: list[str],
    dims: int = 8,
    per_width: int = 8,
    epochs: int = 8,
    batch: int = 128,
    rate: float = 0.01,
    seed: int = 5,
) -> ByteConvNet:
    """Fits the network with Adam; the backward pass touches only the maxima."""
    rng = np.random.default_rng(seed)
    kinds, total = len(languages), per_width * len(WIDTHS)
    params = [rng.normal(0, 0.5, (256, dims))]
    params += [rng.normal(0, (w * dims) ** -0.5, (w, dims, per_width)) for w in WIDTHS]
    params += [np.zeros(total), rng.normal(0, total**-0.5, (total, kinds)), np.zeros(kinds)]
    params = [p.astype(np.float32) for p in params]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    span, step = WINDOW - max(WIDTHS) + 1, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(grids))
        for at in range(0, len(shuffled), batch):
            rows = shuffled[at : at + batch]
            x, n = grids[rows], len(rows)
            emb, filters, bias, dense, dense_bias = params[0], params[1:-3], *params[-3:]
            e = emb[x]
            best, where = [], []
            for w, f in zip(WIDTHS, filters):
                y = sum(e[:, j : j + span].reshape(-1, dims) @ f[j] for j in range(w)).reshape(n, span, -1)
                where.append(y.argmax(1))
                best.append(np.take_along_axis(y, where[-1][:, None], 1)[:, 0])
            top = np.concatenate(best, 1) + bias
            active = np.maximum(top, 0)
            logits = active @ dense + dense_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), labels[rows]] -= 1
            p /= n
            back = (p @ dense.T) * (top > 0)
            grads = [np.zeros_like(emb)]
            for k, (w, f) in enumerate(zip(WIDTHS, filters)):
                g = back[:, k * per_width : (k + 1) * per_width]
                letters = x[np.arange(n)[:, None, None], where[k][:, :, None] + np.arange(w)]
                grads.append(np.einsum("nf,nfwe->wef", g, emb[letters]))
                np.add.at(grads[0], letters, g[:, :, None, None] * f.transpose(2, 0, 1)[None])
            grads += [back.sum(0), active.T @ p, p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - np.float32(rate) * (first[i] / (1 - 0.9**step)) / (
                    np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
                )
    params = [p.astype(np.float32) for p in params]
    return ByteConvNet(languages, params[0], params[1:-3], *params[-3:])


class Scorer:
    """The trained network with its filters spread out over pairs of bytes."""

    def __init__(self, net: ByteConvNet):
        self.net = net
        parts = [[net.embedding @ f[j] for j in range(len(f))] for f in net.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        two, three, four = parts
        self.head = np.concatenate([pair(*two), pair(*three[:2]), pair(*four[:2])], 1)
        self.tail = np.concatenate([pair(three[2], np.zeros_like(three[2])), pair(*four[2:])], 1)
        self.cut = two[0].shape[1]

    def probabilities(self, grids: np.ndarray, step: int = 96) -> np.ndarray:
        out = np.empty((len(grids), len(self.net.languages)), np.float32)
        for at in range(0, len(grids), step):
            x = grids[at : at + step].astype(np.uint16)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            y = self.head[pairs[:, :-2]]
            y[:, :, self.cut :] += self.tail[pairs[:, 2:]]
            active = np.maximum(y.max(1) + self.net.bias, 0)
            logits = active @ self.net.dense + self.net.dense_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + step] = p / p.sum(1, keepdims=True)
        return out


def train(docs: DataFrame, usable: Column, per_language: int = 600, windows_per_text: int = 4) -> ByteConvNet:
    """Fits the network on ``usable`` rows of ``docs`` (doc_id, text, lang).

    The sample is bounded: of each language the ``per_language`` different rows with
    the smallest hashes of key and text, and ``windows_per_text`` evenly spread windows
    of each. Rows that repeat key and text count once, so neither a repeated key nor
    a text that a third of all rows have makes it larger or one-sided.
    """
    rows = docs.select("doc_id", "text", "lang").filter(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("draw")
    smallest = rows.select("lang", "draw").distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language)
    # One row for each language.
    cuts = staged(smallest.groupBy("lang").agg(F.max("draw").alias("cut")), "language-cuts")
    languages = sorted(r["lang"] for r in cuts.select("lang").collect())
    if not languages:
        return ByteConvNet([], np.zeros((256, 1), np.float32), [], *[np.zeros(0, np.float32)] * 3)
    kept = windows_per_text
    sample = (
        rows.join(cuts, "lang")
        .filter("draw <= cut")
        .dropDuplicates(["lang", "draw"])
        .select("lang", "text")
        .mapInArrow(lambda batches: sampled_windows(batches, kept), "lang string, grid binary")
        .toArrow()
    )
    codes = {lang: i for i, lang in enumerate(languages)}
    labels = np.array([codes[v] for v in sample["lang"].to_pylist()], np.int64)
    grids = np.frombuffer(b"".join(sample["grid"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    order = np.lexsort((*grids[:, :8].T, labels))  # whatever order the rows came in
    return learn(grids[order], labels[order], languages)


def sampled_windows(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        grids, owner, _ = windows_of(batch["text"])
        count = np.bincount(owner, minlength=batch.num_rows)
        first = np.cumsum(count) - count
        rows, langs = [], batch["lang"].to_pylist()
        for d in np.flatnonzero(count):
            picks = np.unique(np.linspace(0, count[d] - 1, kept).astype(int))
            rows += [(langs[d], grids[first[d] + i].tobytes()) for i in picks]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "grid"]
        )


def predict(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: scored(batches, net), f"doc_id {kind}, lang_pred string, score double"
    )


def scored(batches: Iterator[pa.RecordBatch], net: ByteConvNet) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(net) if net.languages else None
    for batch in slices(batches, 1 << 20):
        n = batch.num_rows
        known = np.array([bool(t and LETTER.search(t)) for t in batch["text"].to_pylist()], bool)
        if scorer is None:
            known[:] = False
            best, score = np.zeros(n, int), np.zeros(n)
        else:
            grids, owner, filled = windows_of(batch["text"])
            weighted = scorer.probabilities(grids) * filled[:, None]
            sums = np.stack([np.bincount(owner, c, n) for c in weighted.T], 1)
            mean = sums / np.maximum(np.bincount(owner, filled, n), 1)[:, None]
            best, score = mean.argmax(1), mean.max(1)
        names = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(names, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))],
            ["doc_id", "lang_pred", "score"],
        )
