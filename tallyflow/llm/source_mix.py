"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words by weight, but at most ``most`` times
its own words; what the cap leaves over is shared again by weight. A document
then gets target / size-of-source copies in expectation. The whole part is taken
as it stands; the fraction is rounded by the pivotal method, with words as mass:
two documents with fractions trade words until one of them has fraction 0 or 1,
the direction drawn so that every expectation is kept. Each chunk of a source
ends with one open document at most, and open documents of neighbouring chunks
meet in a reduction tree until one is left per source and is rounded by a draw.
So a source's words miss its target by less than one document, and mostly by less
than a small one: documents trade in order of size, and one much larger than the
next trades with all smaller ones of its chunk at once.

Chunks are cut by a hash of key and text, so a source with a third of all rows is many
chunks, as are rows without a key. All draws come from that hash: reruns agree,
wherever the rows are stored. Rows that take nothing wait for no draw.

Defined results: null text has size 0; documents of size 0 take nothing; the null
source is a source and comes last. Rows with the same or no key are ordered by
size; those with the same text too meet in one chunk, in the order of their rows.
With no words at all, targets are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import WORD_PATTERN, numbered, width
from tallyflow.session import staged

WEIGHTS = (1, 2, 3)
FAN_IN = 64
COIN = float(1 << 20)


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size (words) and mark (of key and text) of every row."""
    count = F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long")
    return numbered(docs, "doc_id", "source", "text").select(
        "row", "doc_id", "source", F.coalesce(count, F.lit(0).cast("long")).alias("size"), F.xxhash64("doc_id", "text").alias("mark")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, source_rows and target: one row per source.

    Sources are filled by weight up to their caps. In order of cap / weight, the
    first k are capped exactly if the level that the others reach without them
    is above the k-th cap, so one cumulative sum over sources finds the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        # The level rises while sources are capped and is final from the first that is not.
        .withColumn("open_level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "source_rows", "target")
    )


def settle(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of ``part`` (0 to 1) along the rows; at most one stays open.

    ``draws`` has a number for each row, whose high and low bits are two coins for
    the two trades that its step may hold; no coin decides twice.

    Words are conserved: what one document loses in words the other gains. A
    document more than twice as large as the next would outlast one small partner
    after another, so it trades with all that follow as one bundle.
    """
    part = part.copy()
    low, high = np.modf(draws * COIN)
    high /= COIN
    held = -1
    for i in range(len(part)):
        if not 0.0 < part[i] < 1.0:
            continue
        if held >= 0 and size[held] > 2 * size[i]:
            trade_with_rest(size, part, held, i, low[i])
            if not 0.0 < part[held] < 1.0:
                held = -1
            if not 0.0 < part[i] < 1.0:
                continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        wa, wb = size[a], size[b]
        up = min((1 - part[a]) * wa, part[b] * wb)  # words that a can take from b
        down = min(part[a] * wa, (1 - part[b]) * wb)
        if high[i] * (up + down) < down:
            moved, full, empty = up, (1 - part[a]) * wa <= part[b] * wb, part[b] * wb <= (1 - part[a]) * wa
            part[a] = 1.0 if full else part[a] + moved / wa
            part[b] = 0.0 if empty else part[b] - moved / wb
        else:
            moved, empty, full = down, part[a] * wa <= (1 - part[b]) * wb, (1 - part[b]) * wb <= part[a] * wa
            part[a] = 0.0 if empty else part[a] - moved / wa
            part[b] = 1.0 if full else part[b] + moved / wb
        held = a if 0.0 < part[a] < 1.0 else b if 0.0 < part[b] < 1.0 else -1
    return part


def trade_with_rest(size: np.ndarray, part: np.ndarray, a: int, start: int, draw: float) -> None:
    """One trade of ``a`` with all rows from ``start`` on, until one of them is integral.

    The rest moves along the same line in either direction, so expectations stay.
    """
    rest = part[start:]
    slope = rest * (1 - rest)
    words = float(slope @ size[start:])
    if words <= 0:
        return
    live = slope > 0
    full, empty = (1 - part[a]) * size[a] / words, part[a] * size[a] / words
    up, down = min(full, float((1 / (1 - rest[live])).min())), min(empty, float((1 / rest[live]).min()))
    rising = draw * (up + down) < down
    step, limit = (up, full) if rising else (-down, -empty)
    rest -= step * slope
    rest[live & (rest < 1e-12)] = 0.0
    rest[live & (rest > 1 - 1e-12)] = 1.0
    part[a] = float(rising) if step == limit else part[a] + step * words / size[a]


def settle_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """Largest documents first: they settle among their like, and a small one stays open."""
    rows = rows.sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
    size, part = rows["size"].to_numpy(float), rows["part"].to_numpy()
    rows["part"] = settle(size, part, rows["coin"].to_numpy())
    return rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 11, chunk_rows: int = 1024) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies and taken of every row."""
    sizes = staged(sized(docs), "mix-sizes")
    goals = staged(targets(sizes, weights, most), "mix-targets")
    chunks = width(goals.agg(F.max("source_rows")).first()[0] or 0, chunk_rows, 1)
    # Sources may be null: names are compared as structs of text and nullness.
    named = lambda df: df.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        named(sizes)
        .join(named(goals).drop("source"), "name")
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0.0))
        .withColumn("whole", F.floor("copies"))
        .withColumn("part", F.col("copies") - F.col("whole"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "mark"))
        .withColumn("coin", F.lit(0.0))
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + 2), "mark"), F.ceil(F.col("source_rows") / chunk_rows)))
        .drop("copies", "source_rows")
    )

    def tossed(df: DataFrame, turn: int) -> DataFrame:
        """New coins for every level of the tree."""
        value = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(turn), "mark"), F.lit(1 << 40))
        return df.withColumn("coin", value / float(1 << 40))

    turn = 0
    open_part = (F.col("part") > 0) & (F.col("part") < 1)
    schema = rows.schema
    # Only fractions are traded; all else, such as any number of empty rows, is settled.
    level = staged(tossed(rows.filter(open_part), turn).groupBy("name", "chunk").applyInPandas(settle_chunk, schema), "mix-chunks")
    closed = [rows.filter(~open_part), level.filter(~open_part)]
    left = level.filter(open_part)
    while chunks > 1:
        chunks, turn = -(-chunks // FAN_IN), turn + 1
        met = tossed(left, turn).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN)).groupBy("name", "chunk").applyInPandas(settle_chunk, schema)
        level = staged(met, "mix-residuals")
        closed.append(level.filter(~open_part))
        left = level.filter(open_part)
    closed.append(tossed(left, turn + 1).withColumn("part", (F.col("coin") < F.col("part")).cast("double")))
    done = closed[0]
    for more in closed[1:]:
        done = done.unionByName(more)
    copies = (F.col("whole") + F.round("part")).cast("long")
    return done.select(
        "row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
