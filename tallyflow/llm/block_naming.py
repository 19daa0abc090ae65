"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. Equal blocks meet in one
partition, which sorts them and numbers the different ones: the number is the
block's name. Then adjacent names are paired, the pairs are sorted and numbered
in the same way, and so on until one name is left for each text. Names stand for
contents that were compared, not for hashes, so they cannot collide; hashes only
choose partitions.

Blocks, and pairs at every level, are brought down to the different ones of a
batch before they are shuffled. A block that a third of all texts share reaches
its partition once from each batch, with a list of short references.

Defined results: null counts as the empty text, which is one empty block. Of
equal texts the row with the largest doc_id stays; null keys come before all
others. If rows have the same key, or no key, one of them is chosen by its place
in the input. Every row of the input is one row of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.llm.common import lower_ascii, numbered, slices, text_bytes
from tallyflow.session import staged

BLOCK = 2048
# A reference to a block: row of the input, number of the block, blocks of the text.
REFERENCE = np.dtype([("row", "<i8"), ("block", "<i4"), ("blocks", "<i4")])


def dense_names(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """The different values of ``columns``, sorted and numbered without gaps or repeats.

    The number is a partition's number and a place in it. It is fixed by writing
    the table before it is used.
    """
    distinct = df.select(*columns).distinct().sortWithinPartitions(*columns)
    return staged(distinct.withColumn("name", F.monotonically_increasing_id()), label)


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different blocks of each batch with the references to them, and one row per text.

    Rows of texts have no block; they carry key, digest and number of the row.
    """
    for batch in slices(batches, 16 << 20):
        data, ends = text_bytes(batch["text"])
        data = lower_ascii(data).tobytes()
        seen: dict[bytes, list[tuple[int, int, int]]] = {}
        digests, numbers = [], batch["row"].to_pylist()
        for i, row in enumerate(numbers):
            text = data[ends[i] : ends[i + 1]]
            blocks = max(1, -(-len(text) // BLOCK))
            for b in range(blocks):
                seen.setdefault(text[b * BLOCK : (b + 1) * BLOCK], []).append((row, b, blocks))
            digests.append(hashlib.sha256(text).hexdigest())
        n, m = len(numbers), len(seen)
        nothing = pa.nulls(m, pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch["doc_id"], pa.nulls(m, batch["doc_id"].type)]),
                pa.array(numbers + [None] * m, pa.int64()),
                pa.concat_arrays([pa.array(digests, pa.string()), nothing]),
                pa.array([None] * n + list(seen), pa.binary()),
                pa.array([None] * n + [np.array(v, REFERENCE).tobytes() for v in seen.values()], pa.binary()),
            ],
            ["doc_id", "row", "text_sha256", "block", "refs"],
        )


def named_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of equal blocks in a sorted partition; rows of texts pass through."""
    from pyspark import TaskContext

    name, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        names = []
        for block in batch["block"]:
            block = block.as_py()
            if block is not None and block != last:
                name, last = name + 1, block
            names.append(None if block is None else name)
        yield pa.RecordBatch.from_arrays(
            [batch[c] for c in ("doc_id", "row", "text_sha256", "refs")] + [pa.array(names, pa.int64())],
            ["doc_id", "row", "text_sha256", "refs", "name"],
        )


def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            refs = [np.frombuffer(r.as_buffer(), REFERENCE) for r in part["refs"]]
            names = np.repeat(part["name"].to_numpy(zero_copy_only=False), [len(r) for r in refs])
            refs = np.concatenate(refs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(refs[c])) for c in ("row", "block", "blocks")] + [pa.array(names, pa.int64())],
                ["row", "block", "blocks", "name"],
            )


def identities(docs: DataFrame) -> DataFrame:
    """doc_id, row, text_sha256, level and name of every row of ``docs`` (doc_id, text).

    Two rows have equal texts exactly if level and name are equal.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    spread = F.when(F.col("block").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("block"))
    blocks = numbered(docs, "doc_id", "text").mapInArrow(
        block_rows, f"doc_id {key}, row long, text_sha256 string, block binary, refs binary"
    )
    level_0 = staged(
        blocks.repartition(spread)
        .sortWithinPartitions("block")
        .mapInArrow(named_blocks, f"doc_id {key}, row long, text_sha256 string, refs binary, name long"),
        "block-names",
    )
    rows = level_0.filter(F.col("refs").isNull()).select("doc_id", "row", "text_sha256")
    names = (
        level_0.filter(F.col("refs").isNotNull())
        .select("name", "refs")
        .repartition(F.xxhash64("refs"))
        .mapInArrow(expanded, "row long, block int, blocks int, name long")
    )
    names = staged(names, "block-references")
    level, done = 0, [names.filter("blocks = 1").select("row", F.lit(0).alias("level"), "name")]
    rest = names.filter("blocks > 1")
    while not rest.isEmpty():
        level += 1
        right = F.lead("name").over(pair_window())
        pairs = (
            rest.withColumn("right", F.coalesce(right, F.lit(-1)))
            .filter("block % 2 = 0")
            .select("row", (F.col("block") / 2).cast("int").alias("block"), ((F.col("blocks") + 1) / 2).cast("int").alias("blocks"), F.col("name").alias("left"), "right")
        )
        pairs = staged(pairs, "block-pairs")
        known = dense_names(pairs, ["left", "right"], "pair-names")
        named = staged(pairs.join(known, ["left", "right"]).select("row", "block", "blocks", "name"), "named-pairs")
        done.append(named.filter("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = named.filter("blocks > 1")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.join(found, "row")


def pair_window():
    from pyspark.sql import Window

    return Window.partitionBy("row").orderBy("block")


def find_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and row of every row of ``docs``."""
    rows = staged(identities(docs), "identities")
    groups = rows.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("group_size")
    )
    # Written first: Spark can split the rows of a large group only where both sides
    # of the join are shuffled for it, and the aggregate would be joined as it lies.
    groups = staged(groups, "copy-groups")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        "text_sha256",
        "row",
    )
