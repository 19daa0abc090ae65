"""Approximate nearest neighbours by collision counting over single projections.

Vectors are projected on random lines; for each line a block of vectors keeps one
sorted array of (projection, vector). A query opens a window around its own
projection in every array. Where not enough neighbours are known, all windows
grow by the same factor (virtual rehashing: wider buckets, the same arrays), and a
vector that lies in the window of at least ``THRESHOLD`` lines is verified against
the original vectors. A query is done once its k-th neighbour of the block lies
within the radius that the windows stand for: a vector within that radius is in a
window with a chance of ``P_NEAR`` or more, and so reaches the threshold with some 0.97
or more. A block of vectors that are all alike is verified as a whole.

Nearness is the inner product. Vectors get one more component that makes all of
a block equally long, which turns the largest inner product into the smallest
distance; it serves the projections only. Scores are sums of products of the
original components as doubles, from the first component to the last.

Spark deals rows into runs of blocks and queries into chunks (``vectors.tiles``). A
task goes through the blocks of its run in turn: what is farther than the k best so
far is not looked for in the next block. Runs are shares of all rows by number, so
equal or crowded vectors spread evenly, and every row is indexed.

Defined results: vectors that are null, empty, zero or that hold a null or
non-finite component take no part. Vectors meet those of their own length only. A row is
no neighbour of itself, but rows with its key are. Ties go to the smaller key,
null keys last, then to the earlier row. A null key is no query in the sense of
``vec_id % 20 = 0``, but a candidate. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import numbered
from tallyflow.llm.vectors import TILE, best, blocks, finite, in_order, matrix, tie_order, tiles

LINES = 64
# Width of a window at radius 1, and the chance that a vector at distance 1 lies in it.
WIDTH = 2.2
P_NEAR = math.erf(WIDTH / 2 / math.sqrt(2))
THRESHOLD = math.ceil(LINES * P_NEAR - 2 * math.sqrt(LINES * P_NEAR * (1 - P_NEAR)))
# Radii in lengths of the vectors of a block: unrelated ones are some 1.4 apart, and
# the windows grow in smaller steps where they begin to hold those.
FIRST_RADIUS, FINE_FROM, GROWTH, FINE_GROWTH = 1 / 16, 0.75, 1.4, 1.1
# Windows with more than this share of the block are counted by place instead of walked.
WIDE = 1 / 16
# Queries of a chunk that count at once, and pairs that are verified at once.
IN_STEP = 64


class Block:
    """Some vectors and their sorted projections."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.columns = np.ascontiguousarray(vectors.T)
        n, dims = vectors.shape
        self.scale = float(np.abs(vectors).max()) or 1.0
        scaled = vectors / self.scale
        squares = np.einsum("ij,ij->i", scaled, scaled)
        self.length = math.sqrt(float(squares.max()))
        rest = np.sqrt(np.maximum(self.length**2 - squares, 0))
        self.lines = np.random.default_rng(dims).standard_normal((LINES, dims + 1))
        projected = self.lines[:, :-1] @ scaled.T + self.lines[:, -1:] * rest
        order = np.argsort(projected, axis=1, kind="stable")
        self.order = order.astype(np.int32)
        # Place of each vector in each array; a block has fewer than 65,536 vectors.
        self.place = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.uint16)[None, :], axis=1)
        self.sorted = np.take_along_axis(projected, order, axis=1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, ties: np.ndarray, known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of about the k nearest vectors of each query, nearest first.

        ``own`` is the place of the query itself or -1, ``ties`` the rank of each
        vector among equal scores. ``known`` has the k best scores of each query in
        blocks before this one, -inf where there are fewer: what is farther than those
        is not looked for.
        """
        if known is None:
            known = np.full((len(queries), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(queries), IN_STEP):
            found += self._search(queries[a : a + IN_STEP], own[a : a + IN_STEP], k, ties, known[a : a + IN_STEP])
        return found

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int, ties: np.ndarray, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, q = len(self.vectors), len(queries)
        size = np.abs(queries).max(axis=1, keepdims=True)
        aimed = queries / size
        norms = np.sqrt(np.einsum("ij,ij->i", aimed, aimed))
        # As long as the longest vector: the order of inner products stays, distances are least.
        centre = self.lines[:, :-1] @ (aimed * (self.length / norms)[:, None]).T
        norms = norms * size[:, 0]
        low = np.stack([np.searchsorted(line, c) for line, c in zip(self.sorted, centre)])
        high = low.copy()
        counts = np.zeros((q, n), np.uint8)  # LINES fit
        open_ = np.ones((q, n), bool)  # not verified yet
        open_[np.flatnonzero(own >= 0), own[own >= 0]] = False
        left = open_.sum(axis=1)
        places: list[list[np.ndarray]] = [[] for _ in range(q)]
        scores: list[list[np.ndarray]] = [[] for _ in range(q)]
        best = [np.sort(s) for s in known]
        far = self._distance(known.min(axis=1), norms)
        # A query with k neighbours from earlier blocks begins at the farthest of them, where it ends too.
        radius = np.maximum(FIRST_RADIUS * self.length, np.where(np.isfinite(far), far, 0))
        active = np.flatnonzero(left > 0)
        while len(active):
            half = WIDTH * radius[active] / 2
            new_low = np.stack([np.searchsorted(line, c - half, side="left") for line, c in zip(self.sorted, centre[:, active])])
            new_high = np.stack([np.searchsorted(line, c + half, side="right") for line, c in zip(self.sorted, centre[:, active])])
            new_low, new_high = np.minimum(new_low, low[:, active]), np.maximum(new_high, high[:, active])
            going = []
            for i, query in enumerate(active.tolist()):
                self._count(counts[query], new_low[:, i], low[:, query], high[:, query], new_high[:, i])
                ready = np.flatnonzero((counts[query] >= THRESHOLD) & open_[query])
                if len(ready):
                    open_[query, ready] = False
                    left[query] -= len(ready)
                    places[query].append(ready)
                    scores[query].append(self.vectors[ready] @ queries[query])
                    every = np.concatenate([best[query], scores[query][-1]])
                    best[query] = np.partition(every, len(every) - k)[len(every) - k :]
                    far[query] = self._distance(best[query][:1], norms[query])[0]
                if left[query] and far[query] > radius[query]:
                    going.append(query)
            low[:, active], high[:, active] = new_low, new_high
            active = np.array(going, int)
            wider = radius[active] * np.where(radius[active] < FINE_FROM * self.length, GROWTH, FINE_GROWTH)
            # No farther than the k-th neighbour known; a window of that radius ends the search.
            radius[active] = np.minimum(wider, far[active] * (1 + 1e-12))
        return [self._first(queries[i], places[i], scores[i], k, ties, best[i][0]) for i in range(q)]

    def _distance(self, score: np.ndarray, norm: np.ndarray | float) -> np.ndarray:
        """Of two vectors of the block's length with this inner product; infinite for none."""
        cosine = score / self.scale / norm * self.length
        return np.sqrt(np.maximum(2 * self.length**2 - 2 * cosine, 0))

    def _count(self, counts: np.ndarray, new_low: np.ndarray, low: np.ndarray, high: np.ndarray, new_high: np.ndarray) -> None:
        """Counts the vectors that the windows of all lines hold, from what they held before."""
        size = new_high - new_low
        if size.sum() > WIDE * self.place.size:
            inside = self.place - new_low[:, None].astype(np.uint16) < size[:, None].astype(np.uint16)
            full = size >= self.place.shape[1]  # may not fit 16 bits
            inside[full] = True
            np.sum(inside.view(np.uint8), axis=0, dtype=np.uint8, out=counts)
            return
        edges = zip(self.order, new_low.tolist(), low.tolist(), high.tolist(), new_high.tolist())
        met = [piece for line, a, b, c, d in edges for piece in (line[a:b], line[c:d])]
        counts += np.bincount(np.concatenate(met), minlength=len(counts)).astype(np.uint8)

    def _first(self, query: np.ndarray, places: list[np.ndarray], scores: list[np.ndarray], k: int, ties: np.ndarray, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best with exact scores, no worse than ``kth``; ties and rounding of the first product are settled here."""
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        place, score = np.concatenate(places), np.concatenate(scores)
        # Rounding of a sum in another order is far below this bound.
        place = place[score >= kth - 1e-12 * float(np.abs(query).max()) * self.scale * len(query)]
        exact = np.zeros(len(place))
        for column, x in zip(self.columns, query):
            exact += column[place] * x
        order = np.lexsort((ties[place], -exact))[:k]
        return place[order], exact[order]


RESULT = "query_row long, query_id long, row long, vec_id long, score double"


def search_tile(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """All queries of a tile in its blocks, one block after the other."""
    names = ["query_row", "query_id", "row", "vec_id", "score"]
    if not queries.num_rows or not rows.num_rows:
        return pa.table([pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names], names)
    queries, rows = in_order(queries), in_order(rows)
    vectors, asked = matrix(rows, "vector"), matrix(queries, "vector")
    numbers, wanted = rows["row"].to_numpy(), queries["row"].to_numpy()
    ties = tie_order(rows["vec_id"], numbers)
    at = np.searchsorted(numbers, wanted)
    own = np.where(numbers[np.minimum(at, len(numbers) - 1)] == wanted, at, -1)
    place = np.zeros((len(wanted), 0), np.int64)
    score = np.zeros((len(wanted), 0))
    for start, stop in blocks(len(numbers)):
        inside = np.where((own >= start) & (own < stop), own - start, -1)
        known = np.pad(score, ((0, 0), (0, k - score.shape[1])), constant_values=-np.inf)
        found = Block(vectors[start:stop]).search(asked, inside, k, ties[start:stop], known)
        # The best k of each query so far; missing ones are -inf at the end.
        new_place, new_score = np.zeros((len(found), k), np.int64), np.full((len(found), k), -np.inf)
        for i, (p, s) in enumerate(found):
            new_place[i, : len(p)], new_score[i, : len(s)] = p + start, s
        place, score = np.hstack([place, new_place]), np.hstack([score, new_score])
        order = np.lexsort((ties[place], -score), axis=1)[:, :k]
        place, score = np.take_along_axis(place, order, 1), np.take_along_axis(score, order, 1)
    which, column = np.nonzero(score > -np.inf)
    place = place[which, column]
    return pa.table(
        [
            pa.array(wanted[which]),
            queries["vec_id"].combine_chunks().take(pa.array(which)),
            pa.array(numbers[place]),
            rows["vec_id"].combine_chunks().take(pa.array(place)),
            pa.array(score[which, column]),
        ],
        names,
    )


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score, query_row and row of the neighbours of every query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    """
    rows = numbered(vectors, "vec_id", "embedding")
    usable = rows.filter(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select(
        "row",
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("dims"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    queries, candidates = tiles(usable.filter(is_query), usable)

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        return search_tile(asked, rows, k)

    found = queries.groupBy(*TILE).cogroup(candidates.groupBy(*TILE)).applyInArrow(run, RESULT)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    return best(found, ["query_row"], order, k).select("query_id", "rank", "vec_id", "score", "query_row", "row")
