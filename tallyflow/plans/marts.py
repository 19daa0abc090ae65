"""Tables a dashboard reads, from the monthly results of all batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.calendar import month_of_number
from tallyflow.functions.columns import named
from tallyflow.functions.text import areas_label
from tallyflow.operators.deltas import step_changes
from tallyflow.operators.filters import renamed_areas, with_values
from tallyflow.operators.lookups import splittable, unique_by
from tallyflow.operators.reshape import long_days, long_stats
from tallyflow.operators.rollups import area_month_series, recombined, total_by
from tallyflow.schemas import (
    AREA_ALIASES,
    FLOW_COUNTS,
    WIDE_SERIES_AREA,
    WIDE_SERIES_PLACE,
    SnapshotSpec,
)
from tallyflow.sources import readers
from tallyflow.sources.sinks import RESULT_PARTITIONS

# Pairs of names, in a mapping or in a table of area and known_as.
Aliases = Mapping[str, str] | DataFrame

PAIR_KEYS = (
    "year_month",
    "destination_country",
    "destination_country_code",
    "origin_country",
    "origin_country_code",
)


def monthly_cases(
    rows: DataFrame, spec: SnapshotSpec = SnapshotSpec(), combine: str = "sum"
) -> DataFrame:
    """One row per month and area of all batches, with the monthly change.

    The change is taken anew from the recombined cumulative values.
    """
    merged = recombined(rows, ["year_month", spec.area], spec.cumulative, combine)
    changed = step_changes(
        merged, spec.area, "year_month", dict(zip(spec.monthly_new, spec.cumulative))
    )
    return changed.withColumnsRenamed({"year_month": "month", spec.area: "country"})


def pair_flows(rows: DataFrame, combine: str = "sum") -> DataFrame:
    """Flow counts of all batches per month and pair of countries."""
    merged = recombined(rows, PAIR_KEYS, ["flight_count"], combine)
    return merged.withColumnsRenamed({"year_month": "month", "destination_country": "end_country"})


def destination_flows(pairs: DataFrame) -> DataFrame:
    """Flow counts per month and destination, from the counts per pair.

    Reads the smaller table; grouping sets over the raw rows would double
    them before the first aggregate.
    """
    keys = ["month", "end_country", "destination_country_code"]
    return total_by(pairs, keys, ["flight_count"]).drop("destination_country_code")


LEVELS = {
    "pair": ("origin_country", "origin_country_code", "end_country", "destination_country_code"),
    "destination": ("end_country", "destination_country_code"),
    "origin": ("origin_country", "origin_country_code"),
    "all": (),
}


def flow_hierarchy(pairs: DataFrame) -> DataFrame:
    """Flow counts of every level in one pass over the counts per month and pair.

    Levels are pairs of countries, destinations, origins and all together, each per
    month and over all months; ``level`` and ``period`` (month, all) name them, and columns
    that a level leaves out are NULL. Levels are told apart by ``grouping_id``, not by
    NULLs. The counts are expanded to eight rows each before the aggregate, so hand in
    pairs, not raw flows.
    """
    columns = ["month", *LEVELS["pair"]]
    sets = {(level, period): [*(["month"] if period == "month" else []), *keys] for level, keys in LEVELS.items() for period in ("month", "all")}
    # A bit of the id is set where a column is left out, the first column's bit first.
    ids = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for name, keys in sets.items()}

    def label(part: int):
        chosen = F.lit(None).cast("string")
        for name, number in ids.items():
            chosen = F.when(F.col("_id") == number, F.lit(name[part])).otherwise(chosen)
        return chosen

    known = with_values(pairs, columns)
    counted = known.groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *columns).agg(
        F.grouping_id().alias("_id"), F.sum("flight_count").alias("flight_count")
    )
    return counted.select(label(0).alias("level"), label(1).alias("period"), *columns, "flight_count")


def cases_with_flows(
    cases: DataFrame,
    flows: DataFrame,
    area: str | None = None,
    destination: str | None = None,
    flow_value: str = "flight_count",
    aliases: Aliases = AREA_ALIASES,
) -> DataFrame:
    """Months of the cases, with the flows into the destination or NULL.

    ``area`` picks one country on the side of the cases; its name on the side
    of the flows is ``destination``, or follows from ``aliases``. Without
    ``area`` each country meets the flows into itself. ``aliases`` are pairs in a
    mapping, or in a table such as ``readers.alias_table`` reads, which is joined.
    """
    flows = flows.select("month", "end_country", named(flow_value))
    if area is None:
        keyed = with_known_names(cases, "country", aliases, "end_country")
        return keyed.join(flows, ["month", "end_country"], "left").drop("end_country")
    if destination is None and isinstance(aliases, DataFrame):
        # One name, looked up in the table by the same join.
        names = cases.sparkSession.createDataFrame([(area,)], "country STRING")
        wanted = with_known_names(names, "country", aliases, "end_country").select("end_country")
        one = flows.join(wanted, "end_country").drop("end_country")
        return cases.filter(F.col("country") == area).join(one, "month", "left")
    wanted = destination or dict(aliases).get(area, area)
    one = flows.filter(F.col("end_country") == wanted).drop("end_country")
    return cases.filter(F.col("country") == area).join(one, "month", "left")


def with_known_names(df: DataFrame, name: str, aliases: Aliases, new: str) -> DataFrame:
    """Adds ``new``, the name in the other naming system or the name itself."""
    if not isinstance(aliases, DataFrame):
        return df.withColumn(new, renamed_areas(named(name), dict(aliases)))
    # One row per name, so that a repeated alias does not multiply rows.
    table = unique_by(aliases, "area", "known_as").select(F.col("area").alias("_area"), F.col("known_as").alias("_known_as"))
    joined = df.join(splittable(table), named(name) == F.col("_area"), "left")
    return joined.withColumn(new, F.coalesce("_known_as", named(name))).drop("_area", "_known_as")


def marts(
    cases: DataFrame,
    focus_cases: DataFrame,
    flows: DataFrame,
    area: str = "US",
    spec: SnapshotSpec = SnapshotSpec(),
    combine: str = "sum",
    aliases: Aliases = AREA_ALIASES,
) -> dict[str, DataFrame]:
    """Six tables from the monthly rows of all batches; lazy throughout.

    ``aliases`` are names of areas in the flows where they differ from the cases', as
    for :func:`cases_with_flows`. ``combine`` says what two batches with the same month mean: parts of it to
    add up (``sum``), or the same rows twice, of which the larger counts (``max``).
    """
    all_cases = monthly_cases(cases, spec, combine)
    one_area = monthly_cases(focus_cases, spec, combine)
    pairs = pair_flows(flows, combine)
    ends = destination_flows(pairs)
    keys = ["country", "month"]
    return {
        "focus_with_flows": cases_with_flows(one_area, ends, area, aliases=aliases),
        "destination_flows": ends,
        "monthly_cases": all_cases,
        "cases_long": long_stats(all_cases, keys, spec.month_stats),
        "focus_cases_long": long_stats(one_area, keys, spec.month_stats),
        "pair_flows": pairs,
    }


def marts_from_csv(
    spark: SparkSession,
    cases: str | Sequence[str],
    focus_cases: str | Sequence[str],
    flows: str | Sequence[str],
    area: str = "US",
    combine: str = "sum",
    aliases: Aliases = AREA_ALIASES,
) -> dict[str, DataFrame]:
    """From monthly CSV files; each argument is a glob, a URI or a list.

    Which period a file covers is not known here, so files of overlapping
    batches need ``combine="max"``.
    """
    return marts(
        readers.read_monthly_cases(spark, cases),
        readers.read_monthly_cases(spark, focus_cases),
        readers.read_flow_counts(spark, flows),
        area,
        combine=combine,
        aliases=aliases,
    )


def marts_from_results(
    spark: SparkSession,
    out: str,
    area: str = "US",
    spec: SnapshotSpec = SnapshotSpec(),
    combine: str = "sum",
    aliases: Aliases = AREA_ALIASES,
) -> dict[str, DataFrame]:
    """From the datasets of a batch run that had ``area`` as its only choice.

    Batches and area lists are partitions here, so a list that merely ends in
    the same name cannot slip in. A batch inside the period of another one, such
    as 202101 beside 2021 or beside all, is left out: its files were in the
    other's run too.
    """

    def partition(name: str, columns: T.StructType, areas: str) -> DataFrame:
        rows = readers.read_partitioned(spark, f"{out}/{name}", columns, RESULT_PARTITIONS)
        return widest_batches(rows.filter(F.col("areas") == areas))

    keys = T.StructType().add("year_month", "string").add(spec.area, "string")
    case_columns = reduce(lambda s, c: s.add(c, "long"), spec.month_stats, keys)
    flow_columns = T.StructType.fromDDL(FLOW_COUNTS)
    chosen = areas_label([area])
    return marts(
        partition("cases", case_columns, "all"),
        partition("cases", case_columns, chosen),
        partition("flows", flow_columns, chosen),
        area,
        spec,
        combine,
        aliases,
    )


def widest_batches(rows: DataFrame) -> DataFrame:
    """Rows of batches that lie in no other batch's period.

    Reads the partition values alone for the list of batches, which has a row
    for each run.
    """
    batches = rows.select(F.col("batch").alias("wider")).distinct()
    inside = (F.col("batch") != F.col("wider")) & (
        (F.col("wider") == "all") | F.col("batch").startswith(F.col("wider"))
    )
    within = rows.select("batch").distinct().join(batches, inside).select("batch").distinct()
    return rows.join(within, "batch", "left_anti")


def series_marts(
    wide: DataFrame, end_flows: DataFrame, area: str = "US", how: str = "sum"
) -> dict[str, DataFrame]:
    """The same from a wide daily series and flows by destination.

    ``how`` is ``sum`` or, for a cumulative series, ``max``.
    """
    days = long_days(wide, dropped=WIDE_SERIES_PLACE)
    cases = area_month_series(days, WIDE_SERIES_AREA, "Date", "Confirmed", how=how)
    flows = end_flows.withColumn("month", month_of_number(F.col("month")))
    focus = cases_with_flows(
        cases.withColumnRenamed(WIDE_SERIES_AREA, "country"),
        flows,
        area,
        destination=area,
        flow_value="flights",
    ).withColumnRenamed("Confirmed", "cases")
    return {"focus_with_flows": focus, "destination_flows": flows, "monthly_cases": cases}
