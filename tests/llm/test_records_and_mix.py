"""WARC derivatives, source mix and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry_module
import corpus_pipeline
from tallyflow.llm import byte_pairs, queries, source_mix, warc_derivatives
from tallyflow.session import staged
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_point_to_their_source(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    sources = {r["page_id"]: warc_derivatives.parsed(r["record"]) for r in warc_derivatives.responses(pages).collect()}
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = warc_derivatives.derive(warc_derivatives.responses(pages)).collect()
    assert Counter(r["warc_type"] for r in rows) == {"metadata": len(urls), "conversion": len(urls)}
    ids = {r["record_id"]: r for r in rows}
    for r in rows:
        headers, block = warc_derivatives.parsed(r["record"])
        source, body = sources[r["page_id"]]
        assert headers["warc-refers-to"] == r["refers_to"] == source["warc-record-id"]
        assert headers["warc-target-uri"] == urls[r["page_id"]] and headers["warc-refers-to-date"] == source["warc-date"]
        assert headers["warc-block-digest"] == r["block_digest"] == sha1(block) and block.decode() == r["body"]
        assert r["source_payload_digest"] == source["warc-payload-digest"] == sha1(body.split(b"\r\n\r\n", 1)[1])
        assert ids[r["concurrent_to"]]["concurrent_to"] == r["record_id"]
    text = next(r["body"] for r in rows if r["warc_type"] == "conversion")
    assert "<" not in text and "track(" not in text and "margin" not in text


def test_odd_pages_and_records(spark):
    made = [(1, None, None), (2, "", ""), (None, "u\r\nX: y", "<p>a<p>b&amp;c<script>x</script><br>d"), (3, "u", "<title>T</title><a href='/l'>k</a>"), (3, "u", "<title>T</title><a href='/l'>k</a>"), (4, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").selectExpr("*", "'x' AS record", "'y' AS body")
    rows = warc_derivatives.derive(warc_derivatives.responses(pages)).collect()
    text = {r["page_id"]: r["body"] for r in rows if r["warc_type"] == "conversion"}
    assert len(rows) == 12 and text == {1: "", 2: "", None: "a\nb&c\nd", 3: "k", 4: "deep"}
    fields = next(r["body"] for r in rows if r["page_id"] == 3 and r["warc_type"] == "metadata")
    assert "title: T\r\n" in fields and "outlink: /l\r\n" in fields
    assert warc_derivatives.derive(warc_derivatives.responses(pages.filter("false"))).count() == 0
    whole = warc_derivatives.response_record(1, "u", "<p>é", "2024-01-01T00:00:00Z")
    assert warc_derivatives.derivatives(gzip.compress(whole)) == warc_derivatives.derivatives(whole)
    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n<p>\xe9\r\n0\r\n\r\n"
    record = warc_derivatives.serialised([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", str(len(payload)))], payload)
    assert warc_derivatives.derivatives(record)[1][9] == "é"
    for bad in (b"", b"x", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", whole.replace(b"response\r\n", b"request\r\n", 1), whole.replace(b"HTTP/", b"HTTQ/")):
        assert warc_derivatives.derivatives(bad)[0][1] == "rejected"


def plain_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        if not over:
            return {**share, **{s: most * sizes[s] for s in capped}}
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(table, odd_rows, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["w"] * int(n)), rng.choice(["a", "b", "c", "tiny", None], p=[0.6, 0.2, 0.15, 0.02, 0.03])) for i, n in enumerate(rng.geometric(0.02, 900))]
    rows = [(i, t, None if s is None else str(s)) for i, t, s in rows] + odd_rows
    docs = table(rows)
    got = source_mix.mix(docs, chunk_rows=16).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    largest = {s: max(len(brute.words(t)) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(repr, got)) == sorted(map(repr, source_mix.mix(docs, chunk_rows=16).collect()))


def test_rows_without_a_key_are_dealt_out_by_their_texts(table):
    """A third of the rows has no key, all of one size; their draws and chunks differ like those of others."""
    rows = [(None if i % 3 == 0 else i, f"w{i} x y", "s") for i in range(900)] + [(None, None, "s")] * 200
    docs = table(rows)
    marks = [r["mark"] for r in source_mix.sized(docs).filter("doc_id IS NULL AND size > 0").select("mark").collect()]
    assert len(set(marks)) == 300
    got = source_mix.mix(docs, chunk_rows=16).collect()
    taken = sum(r["taken"] for r in got if r["doc_id"] is None)
    assert len(got) == 1100 and sum(r["taken"] for r in got) == 2700 and taken == 900


def test_mix_of_nothing(table):
    docs = table([(1, "", "a"), (2, None, None)])
    assert {(r["taken"], r["target"]) for r in source_mix.mix(docs).collect()} == {(0, 0.0)}
    assert source_mix.mix(docs.filter("false")).count() == 0


def test_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(0)
    size = np.sort(np.concatenate([rng.integers(1, 300, 30), [9000, 2500]]))[::-1].astype(float)
    part = np.where(np.arange(32) % 5 == 0, 0.2, 0.45)
    sums = np.zeros(32)
    for _ in range(3000):
        out = source_mix.settle(size, part, rng.random(32))
        assert ((out > 0) & (out < 1)).sum() <= 1 and out @ size == pytest.approx(part @ size)
        sums += out
    assert np.abs(sums / 3000 - part).max() < 0.05


def test_pipeline_stage_by_stage(spark):
    docs, at = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = docs
        docs = staged(stage(spark, docs, SF), "test-stage")
    columns = at["quality_classifier"].columns
    assert all(df.columns == columns for df in at.values())
    ids = {name: Counter(r["doc_id"] for r in df.collect()) for name, df in at.items()}
    texts = {r["doc_id"]: r["text"] for r in at["quality_classifier"].collect()}

    scored = {r["doc_id"]: r["predicted"] for r in queries.op8_quality_classifier(spark, SF).collect()}
    assert ids["exact_dedup"] == Counter(i for i in texts if scored[i])
    plain = [(i, texts[i]) for i in ids["exact_dedup"]]
    last = {}
    for i, t in sorted(plain):
        last[t.translate(brute.LOWER)] = i
    assert ids["ngram_jaccard_join"] == Counter(last.values())
    want, _ = brute.classes([(i, texts[i]) for i in ids["ngram_jaccard_join"]])
    assert ids["source_mix"] == Counter({k: 1 for k, _, c in want if k == c})
    taken = {r["doc_id"]: r["copies"] for r in source_mix.mix(at["source_mix"]).collect()}
    assert ids["byte_bpe"] == Counter({k: c for k, c in taken.items() if c})

    ranks = byte_pairs.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = docs.collect()
    assert Counter(r["doc_id"] for r in rows) == ids["byte_bpe"]
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(texts[r["doc_id"]])) for r in rows)


def test_pipeline_over_odd_rows(spark, table, odd_rows):
    docs = table(odd_rows)
    for df in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            last, df = df, staged(stage(spark, df, SF), "test-stage")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert df.columns == docs.columns
            if last.isEmpty():
                assert df.isEmpty()


def test_every_operator_is_registered():
    names = [n for n in entry_module.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14 and {n.split("_")[0] for n in names} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert "op7_exact_dedup" in entry_module.oracle_sql()
