"""Ranked lexical search for many items at once, by shared parts of their scores.

The score of a document for an item is a sum over the item's terms. Items share
terms, so they share parts of that sum. The parts are mined among the items: terms
that occur in exactly the same items form a class; then pairs of parts that many
items have side by side (in order of how many items have them) become a part of
their own, round by round, until no pair occurs twice. Parts of parts form a graph
without cycles, in which an item is a short list of parts.

A task reads its documents in batches. It works out each class once per document,
each pair once from its two parts, and each item from its list: every accumulator
exists once, however many items use it. Of each item a task keeps its best
documents only, which Spark then ranks over all tasks.

Documents are read twice: once from their text, for the counts of the items' terms
that are written as postings by document, and once from those, when the number of
documents and the frequencies of terms are known. Items with the same terms are
one query. Queries are dealt into bundles of about ``BUNDLE_TERMS`` terms, each
with a graph of its own; ``BUNDLES_AT_ONCE`` of them, and their terms, are in
memory at a time, and more take further passes. So what the driver sends out has a
bound (a single longer item aside), and no item or term is left out.

Defined results: terms are runs of ASCII letters, digits and characters beyond
ASCII, with A-Z lower-cased. Null or blank texts have none: such documents are not
counted, such items get no rows. Documents with a score of 0 are not listed. Equal
scores go by ascending doc_id, null keys last; rows with the same key count as
documents of their own. Repeated items get rows of their own, null item_id
included. No documents or no items give no rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import numbered, slices
from tallyflow.llm.vectors import best
from tallyflow.session import staged

Batches = Iterator[pa.RecordBatch]

BUNDLE_TERMS = 20_000
BUNDLES_AT_ONCE = 32
# Accumulators that a task holds at once: parts times documents.
CELLS = 1 << 21

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text in order, repeats included."""
    return (text or "").encode().translate(_KEPT).split()


class Graph:
    """Queries as sums of shared parts.

    Part ``i`` below ``len(classes)`` is a class of (term, repeat) entries; the parts
    after those are pairs of earlier parts. ``lists`` has the parts of each query.
    """

    def __init__(self, classes: list[list[str]], pairs: list[tuple[int, int]], lists: list[list[int]], queries: list[int]):
        self.classes, self.pairs, self.lists, self.queries = classes, pairs, lists, queries

    @classmethod
    def mined(cls, queries: list[int], bags: list[list[str]]) -> Graph:
        """From the terms of each query, with repeats. The second time a term occurs is an entry of its own."""
        used_by: dict[tuple[str, int], list[int]] = defaultdict(list)
        for q, bag in enumerate(bags):
            for term, times in Counter(bag).items():
                for repeat in range(times):
                    used_by[term, repeat].append(q)
        by_queries: dict[tuple[int, ...], list[str]] = defaultdict(list)
        for (term, _), used in sorted(used_by.items()):
            by_queries[tuple(used)].append(term)
        lists: list[list[int]] = [[] for _ in bags]
        for part, used in enumerate(by_queries):
            for q in used:
                lists[q].append(part)
        uses = Counter({part: len(used) for part, used in enumerate(by_queries)})
        pairs: list[tuple[int, int]] = []
        while chosen := cls._round(lists, uses):
            for pair in chosen:
                uses[len(by_queries) + len(pairs)] = 0
                chosen[pair] = len(by_queries) + len(pairs)
                pairs.append(pair)
            for q, parts in enumerate(lists):
                lists[q] = cls._replaced(parts, chosen, uses)
        return cls(list(by_queries.values()), pairs, lists, queries)

    @staticmethod
    def _round(lists: list[list[int]], uses: Counter) -> dict[tuple[int, int], int]:
        """Pairs to become parts in this round: frequent ones of which no two have a part in common."""
        found: Counter = Counter()
        for parts in lists:
            parts.sort(key=lambda p: (-uses[p], p))
            found.update(zip(parts, parts[1:]))
        chosen: dict[tuple[int, int], int] = {}
        taken: set[int] = set()
        least = max(2, max(found.values(), default=0) // 2)
        for pair, times in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if times < least:
                break
            if taken.isdisjoint(pair):
                chosen[pair] = -1
                taken.update(pair)
        return chosen

    @staticmethod
    def _replaced(parts: list[int], chosen: dict[tuple[int, int], int], uses: Counter) -> list[int]:
        out, i = [], 0
        while i < len(parts):
            new = chosen.get((parts[i], parts[i + 1])) if i + 1 < len(parts) else None
            if new is None:
                out.append(parts[i])
                i += 1
                continue
            for part in parts[i : i + 2]:
                uses[part] -= 1
            uses[new] += 1
            out.append(new)
            i += 2
        return out

    def additions(self) -> tuple[int, int]:
        """Sums of two numbers for each document: with shared parts, and without."""
        entries = self.entries()
        shared = sum(len(c) - 1 for c in self.classes) + len(self.pairs) + sum(len(x) - 1 for x in self.lists)
        return shared, sum(sum(entries[p] for p in x) - 1 for x in self.lists)

    def entries(self) -> list[int]:
        size = [len(c) for c in self.classes]
        for a, b in self.pairs:
            size.append(size[a] + size[b])
        return size

    def dumped(self) -> str:
        return json.dumps([self.classes, self.pairs, self.lists, self.queries])

    @classmethod
    def loaded(cls, text: str) -> Graph:
        return cls(*json.loads(text))


class Accumulators:
    """Evaluates a graph for batches of documents."""

    def __init__(self, graph: Graph, place: dict[str, int]):
        self.graph = graph
        entry = sorted((place[t], part) for part, c in enumerate(graph.classes) for t in c)
        of_term = np.array([t for t, _ in entry], np.int64)
        self.part = np.array([p for _, p in entry], np.int64)
        # Entries of each term: most have one, a term that an item repeats has more.
        self.first = np.searchsorted(of_term, np.arange(len(place) + 1))
        self.parts = len(graph.classes) + len(graph.pairs)
        self.step = max(1, CELLS // (self.parts + len(graph.lists)))

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Score of each query (row) for each document (column), from the values of terms in documents."""
        times = self.first[term + 1] - self.first[term]
        run = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        part = self.part[np.repeat(self.first[term], times) + run]
        held = np.zeros((self.parts, docs), np.int64)
        np.add.at(held.reshape(-1), part * docs + np.repeat(doc, times), np.repeat(value, times))
        for i, (a, b) in enumerate(self.graph.pairs, len(self.graph.classes)):
            np.add(held[a], held[b], out=held[i])
        out = np.zeros((len(self.graph.lists), docs), np.int64)
        for total, parts in zip(out, self.graph.lists):
            for p in parts:
                total += held[p]
        return out


class Leaders:
    """The best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.least = np.ones(queries, np.int64)
        self.query = self.score = self.doc = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        query, at = np.nonzero(scores >= self.least[:, None])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, scores[query, at]])
        doc, known = np.concatenate([self.doc, doc[at]]), np.concatenate([self.known, known[at]])
        order = np.lexsort((doc, ~known, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[rank < self.k]
        self.query, self.score, self.doc, self.known = query[rank < self.k], score[kept], doc[kept], known[kept]
        full = rank == self.k - 1
        self.least[query[full]] = score[order[full]]


def item_bags(batches: Batches) -> Batches:
    """The sorted terms of each item; items without a term are left out."""
    for batch in batches:
        bags = [sorted(t.decode() for t in terms(text)) for text in batch["text"].to_pylist()]
        some = pa.array([bool(b) for b in bags])
        kept = batch.filter(some)
        yield pa.RecordBatch.from_arrays([kept["row"], kept["item_id"], pa.array([b for b in bags if b], pa.list_(pa.string()))], ["row", "item_id", "bag"])


def mine_bundle(table: pa.Table) -> pa.Table:
    order = np.argsort(table["query"].to_numpy())
    table = table.take(pa.array(order))
    graph = Graph.mined(table["query"].to_pylist(), table["bag"].to_pylist())
    return pa.table([table["bundle"].combine_chunks()[:1], pa.array([graph.dumped()])], ["bundle", "graph"])


def postings(place: dict[str, int]) -> Callable[[Batches], Batches]:
    """Counts of the given terms for each document with a term, and at the end of a task its documents by term.

    That last row has no ``n``.
    """
    names = ["doc_id", "n", "terms", "times"]

    def made(doc_id: pa.Array, n: list[int | None], found: list[Iterable[int]], times: list[Iterable[int]]) -> pa.RecordBatch:
        columns = [doc_id, pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Batches) -> Batches:
        known = {t.encode(): i for t, i in place.items()}
        frequency = np.zeros(len(known), np.int64)
        for batch in slices(batches):
            some, sizes, found, times = [], [], [], []
            for text in batch["text"].to_pylist():
                words = terms(text)
                some.append(bool(words))
                if not words:
                    continue
                counted = Counter(filter(known.__contains__, words))
                sizes.append(len(words))
                found.append([known[w] for w in counted])
                times.append(counted.values())
            if found:
                frequency += np.bincount(np.concatenate([np.array(f, np.int64) for f in found]), minlength=len(known))
                yield made(batch["doc_id"].filter(pa.array(some)), sizes, found, [list(t) for t in times])
        met = np.flatnonzero(frequency)
        yield made(pa.nulls(1, pa.int64()), [None], [met], [frequency[met]])

    return run


def leaders(graphs: list[str], place: dict[str, int], frequency: dict[int, int], documents: int, words: int, k: int) -> Callable[[Batches], Batches]:
    """The best ``k`` documents of a task for each query."""
    weight = np.zeros(len(place), np.int64)
    for term, df in frequency.items():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def run(batches: Batches) -> Batches:
        evaluated = [Accumulators(Graph.loaded(g), place) for g in graphs]
        best_of = [Leaders(len(e.graph.lists), k) for e in evaluated]
        for batch in batches:
            # Python's integers, as long texts in a large corpus may leave 64 bits on the way.
            length = np.array([100 - 75 + (75 * n * documents) // words for n in batch["n"].to_pylist()], np.int64)
            ends = np.concatenate([[0], np.cumsum(batch["terms"].value_lengths().to_numpy())])
            term, tf = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[doc]))
            known = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].fill_null(0).to_numpy()
            for part, top in zip(evaluated, best_of):
                for a in range(0, batch.num_rows, part.step):
                    b = min(a + part.step, batch.num_rows)
                    s = slice(ends[a], ends[b])
                    used = part.first[term[s] + 1] > part.first[term[s]]
                    found = part.scores(doc[s][used] - a, term[s][used], value[s][used], b - a)
                    top.add(found, ids[a:b], known[a:b])
        for part, top in zip(evaluated, best_of):
            query = np.array(part.graph.queries, np.int64)[top.query]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(top.doc, mask=~top.known), pa.array(top.score)], ["query", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id, score and row of the item, for the ``k`` best documents of every item.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    bags = staged(numbered(items, "item_id", "text").mapInArrow(item_bags, f"row long, item_id {kind}, bag array<string>"), "item-terms")
    queries = staged(bags.groupBy("bag").agg(F.min("row").alias("query")), "item-queries")
    total = queries.agg(F.sum(F.size("bag"))).first()[0] or 0
    bundles = -(-total // BUNDLE_TERMS)
    # Written first, so that Spark can split the join where many items have the same terms.
    asked = bags.join(queries, "bag").select("row", "item_id", "query")
    if not bundles:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), "row").limit(0)
    dealt = queries.select(F.pmod(F.xxhash64("query"), F.lit(bundles)).cast("int").alias("bundle"), "query", "bag")
    graphs = staged(dealt.groupBy("bundle").applyInArrow(mine_bundle, "bundle int, graph string"), "item-graphs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    found = []
    for first in range(0, bundles, BUNDLES_AT_ONCE):
        rows = graphs.filter(F.col("bundle").between(first, first + BUNDLES_AT_ONCE - 1)).orderBy("bundle").collect()
        plans = [r["graph"] for r in rows]
        place = {t: i for i, t in enumerate(sorted({t for p in plans for c in Graph.loaded(p).classes for t in c}))}
        counted = staged(texts.mapInArrow(postings(place), "doc_id long, n long, terms array<int>, times array<long>"), "postings")
        every = counted.filter("n IS NOT NULL")
        sums = every.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
        pair = F.explode(F.arrays_zip("terms", "times")).alias("pair")
        # One row for each term of these bundles.
        frequency = counted.filter("n IS NULL").select(pair).groupBy("pair.terms").agg(F.sum("pair.times").alias("df"))
        frequency = {r["terms"]: r["df"] for r in frequency.collect()}
        task = leaders(plans, place, frequency, sums["documents"], sums["words"] or 1, k)
        found.append(staged(every.mapInArrow(task, "query long, doc_id long, score long"), "leaders"))
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    ranked = best(ranked, ["query"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    return asked.join(staged(ranked, "ranked"), "query").select("item_id", "rank", "doc_id", "score", "row")
