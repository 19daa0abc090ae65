"""Language, quality rules and quality scores."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import language_id, queries, quality_classifier, quality_rules
from tallyflow.llm.common import remainder
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    got = queries.op1_language_id(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(spark, table, odd_rows):
    docs = table(odd_rows)
    english = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    net = language_id.train(english, F.lit(True))
    rows = language_id.predict(docs, net).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        texts = [t for k, t, _ in odd_rows if k == r["doc_id"]]
        if all(not any(c.isalpha() for c in t or "") for t in texts):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert any(r["lang_pred"] in net.languages for r in rows)
    nothing = language_id.train(english.filter("false"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.filter("false"), net).count() == 0


def test_windows_are_scored_as_the_network_says():
    rng = np.random.default_rng(0)
    grids = rng.integers(0, 256, (20, language_id.WINDOW), dtype=np.uint8)
    net = language_id.learn(grids, rng.integers(0, 3, 20), ["a", "b", "c"], epochs=2)
    e = net.embedding[grids]
    span = language_id.WINDOW - max(language_id.WIDTHS) + 1
    best = [
        sum(e[:, j : j + span] @ f[j] for j in range(w)).max(1) for w, f in zip(language_id.WIDTHS, net.filters)
    ]
    logits = np.maximum(np.concatenate(best, 1) + net.bias, 0) @ net.dense + net.dense_bias
    want = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(language_id.Scorer(net).probabilities(grids), want, atol=1e-4)


def test_rule_counts(table, odd_rows):
    got = sorted(
        (tuple(r) for r in quality_rules.statistics(table(odd_rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()),
        key=repr,
    )
    assert got == sorted(((k, *brute.counts(t)) for k, t, _ in odd_rows), key=repr)


def test_expectation_maximisation_equals_a_plain_one(spark):
    rules = [quality_rules.Rule(n, F.lit(False), F.lit(False)) for n in ("a", "b", "c")]
    patterns = [(1, 1, 0, 70), (-1, -1, 0, 20), (1, -1, -1, 6), (-1, 1, 1, 3), (0, 0, 0, 9), (0, 0, -1, 2)]
    df = spark.createDataFrame(patterns, "a int, b int, c int, n long")
    model = quality_rules.fit(df, rules, rounds=10, tolerance=0)
    right = [0.8] * 3
    for _ in range(10):
        sums = [[0.8, 1.0] for _ in rules]
        for *votes, n in patterns:
            odds = math.log(0.7 / 0.3) + sum(v * math.log(r / (1 - r)) for v, r in zip(votes, right))
            good = n / (1 + math.exp(-odds))
            for s, v in zip(sums, votes):
                if v:
                    s[0] += good if v > 0 else n - good
                    s[1] += n
        right = [min(0.98, max(0.5, a / b)) for a, b in sums]
    assert model.accuracy == pytest.approx(right)
    assert quality_rules.fit(df.limit(0), rules).accuracy == [0.8] * 3


def test_rules_keep_prose_and_drop_junk(spark, table, odd_rows):
    rows = queries.op3_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.05 * len(junk)
    judged = quality_rules.judge(table(odd_rows)).collect()
    assert len(judged) == len(odd_rows) and all(r["kept"] is not None and r["base_failed"] is not None for r in judged)
    assert quality_rules.judge(table(odd_rows).filter("false")).count() == 0


def test_no_python_in_the_rules(spark):
    plan = quality_rules.statistics(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_of_held_out_documents(spark):
    rows = queries.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_texts_and_labels(spark, table, odd_rows):
    stats = quality_classifier.statistics(table(odd_rows))
    labels = [(4, 1), (4, 0), (5, 1), (14, 0), (14, None), (None, 1), (11, 7), (999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("x"))
    model = quality_classifier.train(stats, labels, remainder("doc_id", 5) != 9)
    rows = quality_classifier.score(stats, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    none = quality_classifier.train(stats, labels.filter("false"), F.lit(True))
    assert {r["score"] for r in quality_classifier.score(stats, none).collect()} == {0.5}
    assert quality_classifier.score(stats.filter("false"), model).count() == 0


def test_sums_and_calibration():
    knots, levels = quality_classifier.isotonic(np.array([2.0, 0, 2, 4]), np.array([1.0, 0, 0, 4]), np.array([0.2, 0, 0.8, 3.6]))
    assert knots.tolist() == [0.25, 0.9] and levels.tolist() == [0.25, 1.0]


def test_the_sample_is_bounded_whatever_the_keys(spark, monkeypatch):
    """A third of the rows has no key, and a third is one row again and again."""
    rows = [(None if i % 3 == 0 else i, f"some words number {i} of a text" if i % 3 else f"other words {i}", "en") for i in range(600)]
    rows += [(7, "the same text for ever", "en")] * 300 + [(i, f"kurzer satz nummer {i}", "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language_id, "learn", lambda grids, labels, languages: seen.update(labels=labels, grids=grids, languages=languages))
    language_id.train(docs, F.lit(True), per_language=100, windows_per_text=4)
    counts = np.bincount(seen["labels"])
    # These texts fill one window each.
    assert seen["languages"] == ["de", "en"] and counts.tolist() == [20, 100]
    texts = [bytes(g).rstrip(b"\x00 ") for g in seen["grids"][seen["labels"] == 1]]
    without_key = sum(t.startswith(b"other") for t in texts)
    assert len(set(texts)) == 100 and 15 <= without_key <= 55
