"""Days and months that do not depend on the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.columns import named


def utc_day(df: DataFrame, column: str) -> Column:
    """The UTC calendar day of a date, timestamp_ntz, timestamp or text column."""
    kind = df.schema[column].dataType
    value = named(column)
    if isinstance(kind, T.StringType):
        return F.to_date(value.try_cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampType):
        days = F.floor(F.unix_seconds(value) / F.lit(86400))
        return F.date_from_unix_date(days.cast("int"))
    return F.to_date(value)


def within_years(df: DataFrame, column: str, first: int, last: int) -> Column:
    """True from the first day of ``first`` to the last day of ``last``.

    The bounds are literals of the column's own type, so the comparison can be
    pushed down to a Parquet scan, which ``year(column)`` cannot.
    """
    start, stop = dt.date(first, 1, 1), dt.date(last + 1, 1, 1)
    kind = df.schema[column].dataType
    value = named(column)
    if isinstance(kind, T.TimestampType):
        epoch = dt.date(1970, 1, 1)
        low, high = (F.timestamp_seconds(F.lit((d - epoch).days * 86400)) for d in (start, stop))
    elif isinstance(kind, T.TimestampNTZType):
        low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (start, stop))
    elif isinstance(kind, T.DateType):
        low, high = F.lit(start), F.lit(stop)
    else:
        value = utc_day(df, column)
        low, high = F.lit(start), F.lit(stop)
    return (value >= low) & (value < high)


def month_text(day: Column) -> Column:
    """``yyyy-MM`` of a date; text order equals time order."""
    return F.date_format(day, "yyyy-MM")


def month_number(text: Column) -> Column:
    """Months since year 0 of a ``yyyy-MM`` text, so that neighbours differ by 1."""
    year, month = (F.substring(text, *at).try_cast("int") for at in ((1, 4), (6, 2)))
    return year * 12 + month - 1


def number_month(number: Column) -> Column:
    """The ``yyyy-MM`` text of such a number."""
    year, month = F.floor(number / 12).cast("string"), (F.pmod(number, F.lit(12)) + 1).cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"))


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_of_number(value: Column) -> Column:
    """``yyyy-MM`` of a number such as 202101; NULL when it is not a month."""
    text = value.cast("string")
    month = F.try_to_timestamp(F.concat(text, F.lit("01")), F.lit("yyyyMMdd"))
    return F.when(F.length(text) == 6, F.date_format(month, "yyyy-MM"))


def short_day(text: Column, pattern: str) -> Column:
    """A day written as in a column header, for example ``1/22/20``.

    A two-digit year from 69 on belongs to the last century; Spark alone would
    place every such year in this one.
    """
    day = F.to_date(F.try_to_timestamp(text, F.lit(pattern)))
    if "yyyy" in pattern:
        return day
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
