"""Exact copies, near copies and repeated passages against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyflow.llm import block_naming, jaccard_join, repeated_passages
from tallyflow.llm.components import components
from tests.llm import brute


def key(row):
    return tuple((x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x) for x in row)


def same(df, columns, want):
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def random_rows(seed, n=160):
    """Texts over few words, pieces of each other, with near and exact copies."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            text = rng.choice(texts)
        elif texts and kind < 0.6:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
            text = " ".join(w)
        elif texts and kind < 0.75:
            a, b = rng.choice(texts).split(" "), rng.choice(texts).split(" ")
            text = " ".join(a[: rng.randint(1, len(a))] + b[rng.randrange(len(b)) :])
        else:
            text = " ".join(f"t{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 19, 20, 21, 60, 150])))
        texts.append(text)
        rows.append((rng.randrange(10 * n), text, "s"))
    return rows


@pytest.fixture(params=["odd", 1, 2])
def rows(request, odd_rows):
    return odd_rows if request.param == "odd" else random_rows(request.param)


def test_exact_copies(table, rows):
    df = block_naming.find_copies(table(rows))
    plain = [(k, t) for k, t, _ in rows]
    same(df, ["doc_id", "keep_id", "group_size", "text_sha256"], brute.copies(plain))
    kept = [r for r in df.collect() if r["kept"]]
    assert len(kept) == len({(t or "").translate(brute.LOWER) for _, t in plain})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_repeated_passages(table, rows):
    plain = [(k, t) for k, t, _ in rows]
    df = repeated_passages.remove_repeats(table(rows))
    same(df, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.without_repeats(plain))


@pytest.mark.parametrize("chunk, tokens", [(768, 1 << 21), (3, 1 << 21), (768, 400)])
def test_near_copies(table, rows, chunk, tokens, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "TOKENS", tokens)
    plain = [(k, t) for k, t, _ in rows]
    want, groups = brute.classes(plain)
    df = jaccard_join.near_copies(table(rows))
    same(df, ["doc_id", "n_shingles", "component_id"], want)
    assert df.filter("kept").count() == len(set(groups))


def test_near_copies_in_a_chain_that_no_centre_reaches(table):
    """Each text is near the next one only."""
    w = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([f"y{i}_{k}" if k < 0 else w[k] if k >= 5 * i else f"z{k}" for k in range(100)]), "s") for i in range(12)]
    want, groups = brute.classes([(k, t) for k, t, _ in rows])
    assert len(set(groups)) == 1
    same(jaccard_join.near_copies(table(rows)), ["doc_id", "n_shingles", "component_id"], want)


def sequence_of(grams):
    seq = repeated_passages.Sequence.__new__(repeated_passages.Sequence)
    seq.grams, seq.windows = grams, np.arange(len(grams) - repeated_passages.GRAMS + 1)
    return seq


def test_anchors_of_more_words_than_a_place_has_bits_for(monkeypatch):
    """Each anchor lies in its window, and equal windows have equal anchors wherever they are."""
    n = (1 << 24) + 100_000
    grams = np.random.default_rng(2).integers(0, 1 << 63, n, dtype=np.uint64)
    grams[1 << 22 : (1 << 22) + 40] = 7  # ties across the end of a run
    grams[5000:5040] = 7
    grams[-50_000:] = grams[1000:51_000]
    found = sequence_of(grams).anchors() - np.arange(n - 15)
    assert found.min() >= 0 and found.max() < 16
    assert np.array_equal(found[n - 50_000 : n - 15], found[1000 : 51_000 - 15])
    assert np.array_equal(found[1 << 22 : (1 << 22) + 25], found[5000:5025])
    short = grams[:20_000]
    monkeypatch.setattr(repeated_passages, "RUN", 37)
    assert np.array_equal(sequence_of(short).anchors() - np.arange(len(short) - 15), found[: len(short) - 15])


def test_empty_table(table):
    none = table([(1, "x", "s")]).filter("doc_id > 1")
    assert block_naming.find_copies(none).count() == 0
    assert jaccard_join.near_copies(none).count() == 0
    assert repeated_passages.remove_repeats(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201)]
    found = {r["row"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_frequent_shingles_are_settled_in_their_batch(table, monkeypatch):
    """A line that every document has, and a group of equal documents."""
    line = "this line is in every document of all"
    rows = [(i, f"{line} " + " ".join(f"d{i}_{k}" for k in range(i % 9)), "s") for i in range(150)]
    want, _ = brute.classes([(k, t) for k, t, _ in rows])
    same(jaccard_join.near_copies(table(rows)), ["doc_id", "n_shingles", "component_id"], want)
