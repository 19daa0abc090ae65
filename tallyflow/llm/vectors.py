"""What the operators on embeddings share: usable rows, blocks of rows, tiles of queries and blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import staged

BLOCK_ROWS = 8192
# Blocks that a task goes through one after the other, with what it knows from those before.
BLOCKS_IN_RUN = 8
QUERY_ROWS = 512
# A run or chunk has at most so many components, however long its vectors are.
CELLS = 1 << 22

TILE = ("dims", "run", "chunk")


def finite(vector: Column) -> Column:
    """True for a vector with components that are all finite numbers; never NULL."""
    known = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(known & (F.size(vector) > 0), F.lit(False))


def share(row: Column, parts: Column, seed: int) -> Column:
    """One of ``parts`` even shares of the rows, by their number."""
    return F.pmod(F.xxhash64(row, F.lit(seed)), parts).cast("int")


def tiles(queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames (row, dims, ...) dealt out so that each query meets each row of its length once.

    Rows of a length ``dims`` are cut into runs and queries into chunks of bounded
    size, by their number; a tile is a run with a chunk. A query goes to every run and
    a row to every chunk: a search of stated queries in all rows, run by run, in which
    no task holds more than one tile.
    """

    def parts(df: DataFrame, name: str, most: int) -> DataFrame:
        size = F.greatest(F.least(F.lit(most), F.floor(F.lit(CELLS) / F.col("dims"))), F.lit(1))
        return df.groupBy("dims").agg(F.count("*").alias("n")).select("dims", F.ceil(F.col("n") / size).cast("int").alias(name))

    # One row for each length, written so that Spark sees how small it is.
    runs, chunks = parts(rows, "runs", BLOCK_ROWS * BLOCKS_IN_RUN), parts(queries, "chunks", QUERY_ROWS)
    plan = staged(runs.join(chunks, "dims"), "tiles")

    def dealt(df: DataFrame, own: str, owns: str, other: str, others: str, seed: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other)
        # Aliases, as both frames may come from one and are grouped together.
        return df.join(plan, "dims").select(*[F.col(c).alias(c) for c in df.columns], share(F.col("row"), F.col(owns), seed).alias(own), every)

    return dealt(queries, "chunk", "chunks", "run", "runs", 1), dealt(rows, "run", "runs", "chunk", "chunks", 2)


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a tile in the order of their numbers, whatever order a shuffle gave them."""
    return table.take(pa.array(np.argsort(table["row"].to_numpy())))


def blocks(rows: int) -> list[tuple[int, int]]:
    """Even blocks of a run."""
    n = -(-rows // BLOCK_ROWS)
    edges = [rows * i // n for i in range(n + 1)] if n else [0]
    return list(zip(edges, edges[1:]))


def matrix(table: pa.Table, name: str, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    column = table[name].combine_chunks()
    if not len(column):
        return np.zeros((0, 1), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def tie_order(keys: pa.ChunkedArray, numbers: np.ndarray) -> np.ndarray:
    """Rank of each row by key, null last, then by number."""
    order = np.lexsort((numbers, keys.fill_null(0).to_numpy(), keys.is_null().to_numpy()))
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def best(found: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; groups are cut down before the shuffle too."""
    window = Window.partitionBy(*by).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
