"""From raw documents to tokens: what a training corpus goes through, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined results: rows with null or empty texts are scored like others by the
first stage; of rows with equal texts one stays; a source, null included, that
gets no words leaves the corpus. With no documents at all every stage is empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import block_naming, byte_pairs, jaccard_join, quality_classifier, source_mix
from tallyflow.llm.common import numbered, on_storage, read, remainder
from tallyflow.session import staged

ROW = "_row_of_this_stage"


def by_row(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` joined with decisions on the place of a row on storage, which ``decided`` calls ROW."""
    return numbered(docs, *docs.columns, name=ROW).join(decided, ROW)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is 0.3 or more."""
    stats = staged(quality_classifier.statistics(docs), "quality-stats")
    model = quality_classifier.train(stats, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality_classifier.keep(docs, model, 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest key."""
    docs = on_storage(docs)
    kept = block_naming.find_copies(docs).filter("kept").select(F.col("row").alias(ROW))
    return by_row(docs, kept).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 75 % of common shingles, the one with the smallest key."""
    docs = on_storage(docs)
    kept = jaccard_join.near_copies(docs).filter("kept").select(F.col("row").alias(ROW))
    return by_row(docs, kept).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it."""
    docs = on_storage(docs)
    taken = source_mix.mix(docs).filter("copies > 0").select(F.col("row").alias(ROW), F.col("copies").alias(f"{ROW}_copies"))
    copies = F.explode(F.array_repeat(F.lit(1), F.col(f"{ROW}_copies").cast("int"))).alias(f"{ROW}_copy")
    return by_row(docs, taken).select(*docs.columns, copies).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_pairs.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenise),
]

# Training, the order of random draws and byte-pair merges have no SQL form; the
# pipeline is tested against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
