"""Nearest neighbours, hard negatives and ranked search against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import collision_search, lexical_search, threshold_mining, vectors
from tallyflow.session import stage_path

NAN, INF = float("nan"), float("inf")
EXTRA = ", ".join(f"{c} string" for c in ("row", "dims", "vector", "score", "rank", "block", "chunk", "n", "query"))


@pytest.fixture(scope="session")
def written(spark):
    def make(rows, schema):
        path = stage_path(spark, "test-vectors")
        full = [(*r, *["x"] * (EXTRA.count(",") + 1)) for r in rows]
        spark.createDataFrame(full, f"{schema}, {EXTRA}").repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def vector_table(written, rows):
    return written(rows, "vec_id long, embedding array<float>, label int")


def single(x):
    """A component as it comes back from a column of floats."""
    return None if x is None else float(np.float32(x))


def random_vectors(seed, n=400, dims=16, copies=0.3):
    """Groups of near and exact copies, vectors of all lengths, and unusable ones."""
    rng = np.random.default_rng(seed)
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < copies:
            v = made[int(rng.integers(len(made)))] + (0 if rng.random() < 0.4 else rng.normal(0, 0.05, dims))
        else:
            v = rng.normal(0, 1, dims) * rng.choice([0.2, 1, 1, 1, 3])
        made.append(v)
        rows.append((i, [float(x) for x in v], int(rng.integers(10))))
    odd = [None, [], [0.0] * dims, [None] * dims, [NAN] + [1.0] * (dims - 1), [INF] + [1.0] * (dims - 1), [1.0, 2.0], [0.5, -2.0], [3.0]]
    rows += [(1000 + 20 * i, v, i % 3) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 1), (20, rows[1][1], 2), (40, rows[40][1], None), (100, rows[2][1], 3), (100, rows[2][1], 3)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def by_key(key):
    return (key is None, key or 0)


def plain_nearest(rows, k):
    rows = [(i, key, [single(x) for x in v]) for i, (key, v, _) in enumerate(rows) if usable(v) and any(x != 0 for x in v)]
    out = {}
    for i, key, v in rows:
        if key is not None and key % 20 == 0:
            scored = [(-product(v, w), by_key(other), other) for j, other, w in rows if j != i and len(w) == len(v)]
            out.setdefault(key, []).append([(other, -s) for s, _, other in sorted(scored, key=lambda x: x[:2])[:k]])
    return out


@pytest.mark.parametrize("seed, block", [(1, 8192), (2, 64)])
def test_nearest(written, monkeypatch, seed, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
    rows = random_vectors(seed)
    want = plain_nearest(rows, 20)
    table = vector_table(written, rows)
    found = collision_search.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault((r["query_id"], r["query_row"]), []).append((r["vec_id"], r["score"]))
    assert sorted(k for k, _ in got) == sorted(k for k, lists in want.items() for x in lists if x)
    hits = total = 0
    for (key, _), mine in got.items():
        best = max(want[key], key=lambda x: len(set(x) & set(mine)))
        assert len(mine) == len(best)
        scores = [s for _, s in mine]
        assert scores == sorted(scores, reverse=True)
        # Equal scores are in the order of keys.
        assert all(a[1] > b[1] or by_key(a[0]) <= by_key(b[0]) for a, b in zip(mine, mine[1:]))
        hits, total = hits + sum((Counter(best) & Counter(mine)).values()), total + len(best)
    assert hits / total >= 0.95


def in_a_tile(monkeypatch, rows, block):
    """Rows as a tile of the operators holds them, in small blocks."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    table = pa.table({"row": np.arange(len(rows)), "vec_id": [k for k, _, _ in rows], "vector": [v for _, v, _ in rows], "label": [x for _, _, x in rows]})
    return table.take(pa.array(np.random.default_rng(0).permutation(len(rows))))


def test_blocks_of_a_run(monkeypatch):
    """What earlier blocks found bounds the later ones, and changes no result."""
    rows = [r for r in random_vectors(6, n=600) if usable(r[1]) and len(r[1]) == 16 and any(r[1]) and r[2] is not None]
    asked = [(k, v, x) for k, v, x in rows if k is not None and k % 20 == 0]
    want = {}
    for block in (50, 8192):
        table = in_a_tile(monkeypatch, rows, block)
        queries = table.filter(pa.array([k is not None and k % 20 == 0 for k in table["vec_id"].to_pylist()]))
        found = collision_search.search_tile(queries, table, 20).to_pylist()
        assert len(found) == 20 * len(asked)
        exact = {}
        for r in found:
            exact.setdefault(r["query_row"], set()).add((r["row"], r["score"]))
        for i, (k, v, _) in enumerate(rows):
            if i in exact:
                best = sorted(((-product(v, w), by_key(o), j) for j, (o, w, _) in enumerate(rows) if j != i))[:20]
                want[i] = {(j, -s) for s, _, j in best}
        assert sum(len(want[i] & exact[i]) for i in want) >= 0.93 * 20 * len(want)
        found = threshold_mining.positives_of_tile(units(queries), units(table))
        got = sorted((r["anchor_row"], r["row"], r["score"]) for r in found.to_pylist())
        assert got == sorted(best_of_label(rows, exact))


def units(table):
    scaled = [[math.floor(256 * x) for x in v] for v in table["vector"].to_pylist()]
    return table.set_column(2, "vector", pa.array(scaled, pa.list_(pa.int64())))


def best_of_label(rows, queries):
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    for i in queries:
        scored = [(-sum(y * z for y, z in zip(whole[i], w)), by_key(rows[j][0]), j) for j, w in enumerate(whole) if j != i and rows[j][2] == rows[i][2]]
        yield from ((i, j, -s) for s, _, j in sorted(scored)[:5])


def test_nearest_among_many(spark):
    """Recall on unrelated vectors, which is the hard case, in a block of full size."""
    x = np.random.default_rng(5).normal(size=(4000, 64))
    asked = np.arange(0, 4000, 200)
    found = collision_search.Block(x).search(x[asked], asked, 20, np.arange(4000))
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(b) & set(p)) / 20 for b, (p, _) in zip(best, found)]) >= 0.9


def test_a_later_block_is_searched_in_one_step(monkeypatch):
    """Windows as wide as the k-th neighbour known end a search, so there is no need of narrower ones."""
    x = np.random.default_rng(3).normal(size=(3000, 32))
    asked, none = x[:40], np.full(40, -1)
    first = collision_search.Block(x[1000:2000]).search(asked, none, 20, np.arange(1000))
    known = np.array([score for _, score in first])
    later, steps, count = collision_search.Block(x[2000:]), [], collision_search.Block._count
    monkeypatch.setattr(collision_search.Block, "_count", lambda *a: (steps.append(1), count(*a)))
    found = later.search(asked, none, 20, np.arange(1000), known)
    assert len(steps) <= len(asked)
    scores = asked @ x[2000:].T
    least = np.sort(np.hstack([known, scores]), axis=1)[:, -20]
    nearer = [set(np.flatnonzero(s >= m - 1e-9)) for s, m in zip(scores, least)]
    assert sum(len(n & set(p)) for n, (p, _) in zip(nearer, found)) >= 0.9 * sum(map(len, nearer))


def test_one_vector_repeated(written):
    """Of many equal vectors the smallest keys are returned."""
    rows = [(i, [1.0, 2.0, 2.0], 0) for i in range(300)] + [(1000, [0.0, 1.0, 0.0], 1)]
    found = collision_search.nearest(vector_table(written, rows), F.col("vec_id") % 20 == 0, 20).collect()
    for query in (0, 40, 1000):
        got = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])]
        assert got == [i for i in range(21) if i != query][:20]


def test_no_vectors(written):
    none = vector_table(written, [(1, [1.0], 1), (2, None, None)])
    every = F.lit(True)
    assert collision_search.nearest(none.filter("vec_id > 5"), every, 3).count() == 0
    assert collision_search.nearest(none, every, 3).count() == 0
    assert threshold_mining.mine(none, F.col("label"), every).count() == 0
    assert threshold_mining.mine(none.filter("vec_id > 5"), F.col("label"), every).count() == 0


def plain_negatives(rows, step):
    units = []
    for i, (key, v, label) in enumerate(rows):
        if label is not None and usable(v):
            label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
            units.append((i, key, label, [math.floor(256 * single(x)) for x in v]))
    out = []
    for i, key, label, v in units:
        if key is None or key % step:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), k, la, j) for j, k, la, w in units if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], by_key(s[1])))
        for ps, pk, _, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(key, pk, rank, nk, ps, ns) for rank, (ns, nk, _, _) in enumerate(inside, 1)]
    return out


@pytest.mark.parametrize("seed, block", [(3, 8192), (4, 50)])
def test_hard_negatives(written, monkeypatch, seed, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 3)
    rows = random_vectors(seed)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = threshold_mining.mine(vector_table(written, rows), label, F.col("vec_id") % 25 == 0)
    got = [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert sorted(got, key=repr) == sorted(plain_negatives(rows, 25), key=repr) and got


def test_lists_stop_early():
    """One row far ahead of all others ends the reading after the first step."""
    x = np.random.default_rng(1).integers(-20, 20, (5000, 8))
    x[77] = 200
    lists = threshold_mining.Lists(x, np.arange(5000), np.arange(5000))
    steps = []
    original = lists.scores
    lists.scores = lambda anchor, rows: steps.append(len(rows)) or original(anchor, rows)
    anchor = np.full(8, 3)
    ((rows, scores),) = lists.mine(anchor, np.ones(5000, bool), [threshold_mining.EVERY], 1, [threshold_mining.NOTHING])
    assert rows.tolist() == [77] and scores.tolist() == [4800] and sum(steps) < 300


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    bags = [(key, Counter(plain_terms(t)), len(plain_terms(t))) for key, t in docs]
    bags = [b for b in bags if b[2]]
    n, length = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for key, bag, size in bags:
            m = 100 - 75 + (75 * size * n) // length
            score = 0
            for t in plain_terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, by_key(key), key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 300)}"
    docs = [(rng.randrange(500), " ".join(word() for _ in range(rng.randint(1, 80)))) for _ in range(250)]
    docs += [(None, "w1 w2 w3 w4"), (None, "w1 W2\tw3"), (7, None), (8, ""), (9, " \n.,!"), (10, docs[0][1].upper()), (10, docs[0][1])]
    docs += [(11, "Ünï-ñandú 日本語x\x00w5 a1_b2"), (12, " ".join(f"w{i % 250}" for i in range(30_000)))]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(60)]
    items += [(3, items[3][1]), (None, "w1 w1 w2"), (70, None), (71, " "), (72, "absent words"), (73, "ÜNï ünï ñandú 日本語x b2 w1 w1"), (74, "w2 w1 w1")]
    return docs, items


@pytest.mark.parametrize("terms, at_once", [(20_000, 32), (150, 2)])
def test_search(written, monkeypatch, corpus, terms, at_once):
    monkeypatch.setattr(lexical_search, "BUNDLE_TERMS", terms)
    monkeypatch.setattr(lexical_search, "BUNDLES_AT_ONCE", at_once)
    monkeypatch.setattr(lexical_search, "CELLS", 5_000)
    docs, items = corpus
    found = lexical_search.search(written(docs, "doc_id long, text string"), written(items, "item_id long, text string"), 10)
    got = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == sorted(plain_search(docs, items, 10), key=repr)


def test_search_without_documents_or_items(written, corpus):
    docs, items = written(corpus[0], "doc_id long, text string"), written(corpus[1], "item_id long, text string")
    assert lexical_search.search(docs.filter("doc_id = 8"), items, 10).count() == 0
    assert lexical_search.search(docs, items.filter("item_id = 71"), 10).count() == 0
    assert lexical_search.search(docs.filter("doc_id < 0"), items.filter("item_id < 0"), 10).columns == ["item_id", "rank", "doc_id", "score", "row"]


def test_shared_parts(corpus):
    """The graph gives back every query, with fewer additions than queries one by one."""
    bags = [b for b in (sorted(plain_terms(t)) for _, t in corpus[1]) if b]
    graph = lexical_search.Graph.mined(list(range(len(bags))), bags)
    content = [Counter(c) for c in graph.classes]
    for a, b in graph.pairs:
        content.append(content[a] + content[b])
    assert [sum((content[p] for p in parts), Counter()) for parts in graph.lists] == [Counter(b) for b in bags]
    shared, plain = graph.additions()
    assert shared < 0.6 * plain and graph.pairs
    again = lexical_search.Graph.loaded(graph.dumped())
    assert again.lists == graph.lists and [tuple(p) for p in again.pairs] == graph.pairs
