"""Numbers of rows do not depend on how a read is split."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyflow.llm import jaccard_join
from tallyflow.llm.common import numbered
from tallyflow.session import staged, stage_path
from tests.llm import brute

SMALL = {"spark__sql__files__maxPartitionBytes": "5kb"}


@pytest.fixture
def docs(spark, odd_rows):
    """Three files in a folder with a name that has to be escaped."""
    rows = [(i, t, s) for i, (_, t, s) in enumerate(odd_rows)] + [(100 + i, f"a text of its own {i}", "s1") for i in range(60)]
    path = stage_path(spark, "some documents %20")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_splits_do_not_move_numbers(docs, conf):
    want = {r["doc_id"]: r["row"] for r in numbered(docs, "doc_id").collect()}
    assert len(set(want.values())) == len(want) == docs.count()
    with conf(**SMALL):
        assert {r["doc_id"]: r["row"] for r in numbered(docs, "doc_id").collect()} == want
    some = docs.filter("doc_id % 3 = 0")
    assert {r["doc_id"]: r["row"] for r in numbered(some, "doc_id").collect()} == {k: v for k, v in want.items() if k % 3 == 0}


def test_pipeline_when_splits_move_between_two_reads(spark, docs, conf):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = {}
    for i, t in sorted(texts.items()):
        last[(t or "").translate(brute.LOWER)] = i
    classes, _ = brute.classes(list(texts.items()))
    wanted = {"drop_copies": set(last.values()), "drop_near_copies": {k for k, _, c in classes if k == c}}
    for name, want in wanted.items():
        stage = getattr(corpus_pipeline, name)(spark, docs, "")
        with conf(**SMALL):
            assert Counter(r["doc_id"] for r in stage.collect()) == Counter(want)
    stage = corpus_pipeline.mix_sources(spark, docs, "")
    with conf(**SMALL):
        moved = Counter(r["doc_id"] for r in stage.collect())
    assert moved == Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect())


def test_tables_that_are_not_rows_of_files_are_written_first(spark, docs):
    twice = docs.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    assert len({r["row"] for r in numbered(twice, "doc_id").collect()}) == 2 * docs.count()
    made = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, made, "").collect()} == {2, 3}


def test_near_copies_of_picked_rows_and_far_numbers(docs):
    """Rows of a batch that do not follow each other on storage, from several files."""
    some = docs.filter("doc_id % 2 = 0 OR doc_id < 9")
    want, _ = brute.classes([(r["doc_id"], r["text"]) for r in some.collect()])
    got = [tuple(r) for r in jaccard_join.near_copies(some).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(want)
    assert staged(numbered(some, "doc_id"), "test-numbers").count() == some.count()
