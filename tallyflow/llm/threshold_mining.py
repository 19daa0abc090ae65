"""Hard negatives by the threshold algorithm over signed, sorted components.

A block of vectors keeps, for each dimension, its rows sorted by that component.
An anchor reads all lists in step, each from the end that its own sign favours;
a row that turns up in any list is scored at once with all its components, in
integers. What no list has shown yet scores at most the threshold, the anchor's
product with the components last read. An anchor is done with a block once the
threshold is strictly below the worst score that can still count in each of its
windows: then no unseen row can enter, not even on a tie.

The anchor's positives come first: one window, rows of its own label. The positives
of all blocks are merged, and then each positive opens a window of its own, from
``low`` to ``high`` percent of its score, for rows of other labels.

Components are counted in 256ths, rounded down. Spark deals rows into runs of blocks
and anchors into chunks (``vectors.tiles``); a task goes through the blocks of its run
in turn, with the windows as full as the blocks before left them. Runs are shares of
all rows by number, so a label that a third of all rows have spreads evenly.

Defined results: rows with a null label, a null or empty vector, or a null or
non-finite component take no part, nor do rows with components so large (2**20 and
more in vectors of 64) that a score might not fit 64 bits. Zero vectors score 0. Vectors meet those of
their own length only. A row is no positive of itself, rows with its key are. Ties
go to the smaller key, null keys last, then to the earlier row; a null key is no
anchor. Positives with a negative score have an empty window. An empty table, or a
table without anchors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import numbered
from tallyflow.llm.vectors import TILE, best, blocks, finite, in_order, matrix, tie_order, tiles
from tallyflow.session import staged

SCALE = 256
FIRST_DEPTH = 16
POSITIVES, NEGATIVES = 5, 3


class Lists:
    """Some rows of a run, and each dimension's rows in ascending order of that component.

    ``places`` are the places of the rows in the run, ``ties`` ranks all rows of the
    run among equal scores.
    """

    def __init__(self, vectors: np.ndarray, places: np.ndarray, ties: np.ndarray):
        self.vectors, self.places, self.ties = vectors[places], places, ties
        self.exact = self.vectors.astype(np.float64)
        # Sums of products below 2**53 are exact in doubles, which are faster.
        self.bound = float(np.abs(self.exact).max(initial=0)) * vectors.shape[1]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.bound * float(np.abs(anchor).max(initial=0)) >= 2**53:
            return self.vectors[rows] @ anchor
        anchor = anchor.astype(np.float64)
        # Of most rows, all products are sooner made than the rows are picked out.
        some = self.exact[rows] @ anchor if 2 * len(rows) < len(self.exact) else (self.exact @ anchor)[rows]
        return some.astype(np.int64)

    def seen_in_steps(self, anchor: np.ndarray):
        """New rows with their scores, and the most that an unseen row can score; None after the last."""
        n = len(self.vectors)
        rising, falling = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        unseen = np.ones(n, bool)
        depth, before = FIRST_DEPTH, 0
        while before < n and len(rising) + len(falling):
            depth = min(depth, n)
            step = np.zeros(n, bool)
            step[self.order[rising, before:depth].ravel()] = True
            step[self.order[falling, n - depth : n - before].ravel()] = True
            new = np.flatnonzero(step & unseen)
            unseen[new] = False
            last = int(self.sorted[rising, depth - 1] @ anchor[rising]) + int(self.sorted[falling, n - depth] @ anchor[falling])
            more = depth < n and bool(unseen.any())
            yield new, self.scores(anchor, new), last if more else None
            if not more:
                return
            before, depth = depth, depth * 2
        # An anchor of zeros favours no list; all rows score 0.
        rest = np.flatnonzero(unseen)
        yield rest, self.scores(anchor, rest), None

    def first(self, places: np.ndarray, scores: np.ndarray, k: int) -> Found:
        """The k best of some rows; equal scores by the order of ties."""
        if len(places) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            places, scores = places[scores >= kth], scores[scores >= kth]
        order = np.lexsort((self.ties[places], -scores))[:k]
        return places[order], scores[order]

    def mine(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int, int]], k: int, found: list[Found]) -> list[Found]:
        """For each window the k best rows whose score lies in it, ends included.

        ``wanted`` tells which rows of the run count; ``found`` has what earlier lists of
        the run gave for the same windows, and is added to.
        """
        found = list(found)
        going = {i for i, (low, high) in enumerate(windows) if low <= high}
        if not going:
            return found
        for rows, scores, most in self.seen_in_steps(anchor):
            places = self.places[rows]
            use = wanted[places]
            places, scores = places[use], scores[use]
            for i in list(going):
                low, high = windows[i]
                mine, score = found[i]
                # A tie with the k-th best may still come before it.
                least = max(low, int(score[-1])) if len(score) == k else low
                inside = (scores >= least) & (scores <= high)
                if inside.any():
                    found[i] = mine, score = self.first(np.concatenate([mine, places[inside]]), np.concatenate([score, scores[inside]]), k)
                if most is not None and (most < low or (len(score) == k and most < int(score[-1]))):
                    going.discard(i)
            if not going:
                break
        return found


Found = tuple[np.ndarray, np.ndarray]
NOTHING: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
# A window that holds every score.
EVERY = (-(1 << 63), (1 << 63) - 1)


FOUND = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, vec_id long, score long"


def tile_result(asked: pa.Table, of: list[int], rows: pa.Table, found: list[Found], positives: list[dict]) -> pa.Table:
    which = np.repeat(of, [len(r) for r, _ in found]).astype(np.int64)
    place = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    score = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
    of_positive = [p for p, (r, _) in zip(positives, found) for _ in r]
    return pa.table(
        [
            asked["row"].combine_chunks().take(pa.array(which)),
            asked["vec_id"].combine_chunks().take(pa.array(which)),
            *[pa.array([p.get(c) for p in of_positive], pa.int64()) for c in ("row", "vec_id", "score")],
            rows["row"].combine_chunks().take(pa.array(place)),
            rows["vec_id"].combine_chunks().take(pa.array(place)),
            pa.array(score),
        ],
        ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "vec_id", "score"],
    )


def positives_of_tile(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of its own label for each anchor, the anchor itself left out.

    Each label of the anchors has lists of its own rows.
    """
    found: list[Found] = []
    asked, rows = in_order(asked), in_order(rows)
    if rows.num_rows:
        vectors, anchors, numbers = matrix(rows, "vector", np.int64), matrix(asked, "vector", np.int64), rows["row"].to_numpy()
        ties, labels, own = tie_order(rows["vec_id"], numbers), rows["label"].to_numpy(), asked["label"].to_numpy()
        found = [NOTHING] * len(own)
        for label in np.unique(own):
            same = np.flatnonzero(labels == label)
            for start, stop in blocks(len(same)):
                lists = Lists(vectors, same[start:stop], ties)
                for i in np.flatnonzero(own == label).tolist():
                    others = numbers != asked["row"][i].as_py()
                    (found[i],) = lists.mine(anchors[i], others, [EVERY], POSITIVES, [found[i]])
    return tile_result(asked, list(range(len(found))), rows, found, [{}] * len(found))


def negatives_of_tile(asked: pa.Table, rows: pa.Table, low: int, high: int) -> pa.Table:
    """The best rows of other labels in the window of each positive of each anchor."""
    asked, rows = in_order(asked), in_order(rows)
    positives = asked["positives"].to_pylist() if rows.num_rows else []
    # The integers from low to high percent.
    windows = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in own] for own in positives]
    found = [[NOTHING] * len(own) for own in positives]
    if rows.num_rows:
        vectors, anchors = matrix(rows, "vector", np.int64), matrix(asked, "vector", np.int64)
        ties, labels, own = tie_order(rows["vec_id"], rows["row"].to_numpy()), rows["label"].to_numpy(), asked["label"].to_pylist()
        for start, stop in blocks(len(labels)):
            lists = Lists(vectors, np.arange(start, stop), ties)
            for i, label in enumerate(own):
                found[i] = lists.mine(anchors[i], labels != label, windows[i], NEGATIVES, found[i])
    of = [i for i, own in enumerate(positives) for _ in own]
    return tile_result(asked, of, rows, [f for own in found for f in own], [p for own in positives for p in own])


def in_units(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))


def mine(vectors: DataFrame, label: Column, is_anchor: Column, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label. ``label`` and ``is_anchor`` are
    expressions over those; a negative's score is between ``low`` and ``high``
    percent of the positive's.
    """
    rows = numbered(vectors, "vec_id", "embedding", "label")
    usable = rows.withColumn("label", label.cast("long")).filter(F.col("label").isNotNull() & finite(F.col("embedding")))
    largest = F.sqrt(F.lit(2.0**62) / F.size("embedding")) / SCALE
    usable = usable.filter(F.forall("embedding", lambda x: F.abs(x.cast("double")) < largest)).select(
        "row", F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("embedding").alias("dims"), in_units(F.col("embedding")).alias("vector")
    )
    anchors = usable.filter(is_anchor)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]

    asked, candidates = tiles(anchors, usable)
    found = asked.groupBy(*TILE).cogroup(candidates.groupBy(*TILE)).applyInArrow(positives_of_tile, FOUND)
    found = best(found, ["anchor_row"], order, POSITIVES)
    positive = F.struct("rank", "row", "vec_id", "score")
    # At most five rows for each anchor.
    known = staged(found.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(positive)).alias("positives")), "positives")

    asked, candidates = tiles(anchors.join(known, "row"), usable)

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        return negatives_of_tile(asked, rows, low, high)

    found = asked.groupBy(*TILE).cogroup(candidates.groupBy(*TILE)).applyInArrow(run, FOUND)
    found = best(found, ["anchor_row", "positive_row"], order, NEGATIVES)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "anchor_row", "positive_row", "row"
    )
