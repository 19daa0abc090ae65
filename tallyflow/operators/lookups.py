"""Lookups of facts in dimensions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.columns import named
from tallyflow.operators.filters import with_values


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key, so that a lookup never multiplies facts.

    The smallest value wins, which does not depend on row order.
    """
    return with_values(df, [key]).groupBy(named(key)).agg(F.min(named(value)).alias(value))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        with_values(df, [key])
        .groupBy(named(key))
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 1)
    )


def place_table(facilities: DataFrame, codes: DataFrame) -> DataFrame:
    """Facilities with code and name, so that a flow needs one lookup per end."""
    facility = unique_by(facilities, "icao", "country")
    code = unique_by(codes, "country_code", "country")
    places = facility.withColumnRenamed("country", "country_code").join(
        code, "country_code", "left"
    )
    return splittable(places.select("icao", "country_code", "country"))


def splittable(dimension: DataFrame) -> DataFrame:
    """A dimension that AQE can join to skewed facts.

    AQE splits a heavy partition only where both sides of a sort merge join
    come right out of a shuffle made for that join. A dimension that was
    grouped by its key would be joined as it lies; the rebalance makes Spark
    shuffle it, the smaller side, once more.
    """
    return dimension.hint("rebalance")


def attach(
    facts: DataFrame,
    key: str,
    dimension: DataFrame,
    dimension_key: str,
    columns: Mapping[str, str],
    spread: int = 1,
) -> DataFrame:
    """Left join that adds columns of a dimension with unique keys.

    ``columns`` maps dimension columns to their new names. No broadcast is
    forced: Spark broadcasts the dimension when its size, estimated or
    measured by AQE, is under the session's limit, and else joins by sort
    merge, where AQE splits heavy partitions. ``spread`` above 1 salts the
    join as well: each fact goes to one of that many partitions of its key,
    each dimension row to all of them. The salt is a hash of the whole fact,
    so a task that is run again sends its rows to the same places; equal facts
    are expected to be counted together before (:func:`pair_counts`). A salted
    join always sorts and merges: Spark measures the dimension before it is
    repeated, and would broadcast all its copies to every executor.
    """
    right = dimension.select(
        named(dimension_key).alias("_lookup_key"),
        *[named(old).alias(new) for old, new in columns.items()],
    )
    on = named(key) == F.col("_lookup_key")
    if spread <= 1:
        return facts.join(right, on, "left").drop("_lookup_key")
    whole_fact = F.xxhash64(*[named(c) for c in facts.columns])
    salted = facts.withColumn("_fact_salt", F.pmod(whole_fact, F.lit(spread)).cast("int"))
    right = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    )
    both = on & (F.col("_fact_salt") == F.col("_salt"))
    return salted.join(right.hint("merge"), both, "left").drop(
        "_lookup_key", "_salt", "_fact_salt"
    )


def unmatched(names: DataFrame, name: str, known: DataFrame, known_name: str) -> DataFrame:
    """Distinct names that the other table does not know."""
    left = with_values(names.select(named(name)), [name]).distinct()
    right = known.select(named(known_name).alias("_known")).distinct()
    return left.join(right, left[name] == right["_known"], "left_anti")
