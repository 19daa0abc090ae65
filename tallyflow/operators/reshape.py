"""Wide to long, and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.calendar import short_day
from tallyflow.functions.columns import named
from tallyflow.schemas import WIDE_DATE_PATTERN, WIDE_SERIES_AREA


def long_stats(
    df: DataFrame, keys: Sequence[str], stats: Sequence[str], kind: str = "long"
) -> DataFrame:
    """One row per key and stat; a NULL value keeps its row."""
    even = df.select(*[named(k) for k in keys], *[named(s).cast(kind).alias(s) for s in stats])
    return even.unpivot([named(k) for k in keys], [named(s) for s in stats], "stat", "value")


def long_days(
    wide: DataFrame,
    *,
    area: str = WIDE_SERIES_AREA,
    dropped: Sequence[str] = (),
    value: str = "Confirmed",
    day: str = "Date",
    pattern: str = WIDE_DATE_PATTERN,
) -> DataFrame:
    """A series with one column per date as area, day and value."""
    dates = [c for c in wide.columns if c != area and c not in dropped]
    # Text such as 12.0 is a whole number too, hence the step over double.
    even = wide.select(
        named(area), *[named(c).cast("double").cast("long").alias(c) for c in dates]
    )
    rows = even.unpivot([named(area)], [named(c) for c in dates], day, value)
    return rows.withColumn(day, short_day(named(day), pattern))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, aligned by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stat_rows(
    cases: DataFrame, stat: str, keys: Sequence[str] = ("country", "month"), kind: str = "long"
) -> DataFrame:
    """Keys, stat and value of one stat, from long rows or from a wide table.

    From a wide table only that column is read; nothing is unpivoted.
    """
    if "stat" in cases.columns:
        return cases.filter(F.col("stat") == stat)
    return cases.select(
        *[named(k) for k in keys], F.lit(stat).alias("stat"), named(stat).cast(kind).alias("value")
    )
