"""Flows mapped to countries and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.checks.tables import (
    codes,
    customer_facilities,
    flows,
    places,
    sql,
    supplier_facilities,
)
from tallyflow.functions.calendar import day_text
from tallyflow.plans.flows import count_flows, country_pair_counts, map_flows, pair_counts


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_flows(flows(spark, sf_dir), *places(spark, sf_dir))


def known_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by what is known of a flow, with every flow kept."""
    kept = map_flows(
        flows(spark, sf_dir, gaps=True), *places(spark, sf_dir, gaps=True), keep_incomplete=True
    )
    known = {
        "has_day": "day",
        "has_origin": "origin_icao",
        "has_origin_country": "origin_country",
        "has_destination_country": "destination_country",
    }
    return (
        kept.select(*[F.col(c).isNotNull().cast("int").alias(k) for k, c in known.items()])
        .groupBy(*known)
        .agg(F.count("*").alias("flights"))
    )


def named_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete flows by country at either end, domestic ones included."""
    complete = map_flows(flows(spark, sf_dir, gaps=True), *places(spark, sf_dir, gaps=True))
    return complete.groupBy("origin_country", "destination_country").agg(
        F.count("*").alias("flights")
    )


def by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_flows(mapped(spark, sf_dir), "origin", "day")
    return counts.withColumn("day", day_text(F.col("day")))


def by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_flows(mapped(spark, sf_dir), "origin", "year_month")


def direct(
    spark: SparkSession,
    sf_dir: str,
    flow_table: DataFrame,
    direction: str = "origin",
    granular: str = "year_month",
    countries: list[str] | None = None,
    gaps: bool = False,
) -> DataFrame:
    return country_pair_counts(
        flow_table,
        supplier_facilities(spark, sf_dir, gaps),
        codes(spark, sf_dir),
        direction,
        granular,
        countries,
        destination_facilities=customer_facilities(spark, sf_dir),
    )


def by_month_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direct(spark, sf_dir, flows(spark, sf_dir))


def pairs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result, with flows of a pair counted before the lookups."""
    return direct(spark, sf_dir, pair_counts(flows(spark, sf_dir)))


def direct_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into two countries by day, from flows and facilities with gaps."""
    counts = direct(
        spark,
        sf_dir,
        flows(spark, sf_dir, gaps=True),
        "destination",
        "day",
        ["NATION_4", "NATION_9"],
        gaps=True,
    )
    return counts.withColumn("day", day_text(F.col("day")))


def spread_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result, with each busy facility spread over eight partitions."""
    wide = map_flows(flows(spark, sf_dir), *places(spark, sf_dir), spread=8)
    return count_flows(wide, "origin", "year_month")


def from_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_flows(
        mapped(spark, sf_dir), "origin", "year_month", ["NATION_3", "NATION_7"]
    )


def into_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_flows(mapped(spark, sf_dir), "destination", "day", ["NATION_9"])
    return counts.withColumn("day", day_text(F.col("day")))


QUERIES = {
    "facility_lookup_left": known_ends,
    "code_to_name_lookup": named_ends,
    "flow_counts_daily": by_day,
    "flow_counts_monthly": by_month_direct,
    "flow_counts_monthly_mapped": by_month,
    "flow_counts_with_gaps": direct_with_gaps,
    "flow_counts_pairs_first": pairs_first,
    "flow_counts_spread_lookup": spread_lookup,
    "flow_counts_by_origin": from_countries,
    "flow_counts_to_country": into_country,
}

DAILY = """
    SELECT strftime(day, '%Y-%m-%d') AS day, origin_country, origin_country_code,
           destination_country, destination_country_code, count(*) AS flight_count
    FROM mapped WHERE origin_country_code <> destination_country_code {where}
    GROUP BY 1, 2, 3, 4, 5"""

SQL = {
    "facility_lookup_left": sql(
        """SELECT CAST(day IS NOT NULL AS INT) AS has_day,
        CAST(origin_icao IS NOT NULL AS INT) AS has_origin,
        CAST(origin_country IS NOT NULL AS INT) AS has_origin_country,
        CAST(destination_country IS NOT NULL AS INT) AS has_destination_country,
        count(*) AS flights FROM gap_mapped GROUP BY 1, 2, 3, 4"""
    ),
    "code_to_name_lookup": sql(
        """SELECT origin_country, destination_country, count(*) AS flights FROM gap_mapped
        WHERE day IS NOT NULL AND origin_country IS NOT NULL AND destination_country IS NOT NULL
        GROUP BY 1, 2"""
    ),
    "flow_counts_daily": sql(DAILY.format(where="")),
    "flow_counts_monthly": sql("SELECT * FROM flow_counts"),
    "flow_counts_monthly_mapped": sql("SELECT * FROM flow_counts"),
    "flow_counts_with_gaps": sql(
        """SELECT strftime(day, '%Y-%m-%d') AS day, origin_country, origin_country_code,
        destination_country, destination_country_code, count(*) AS flight_count
        FROM gap_mapped WHERE origin_country_code <> destination_country_code
        AND day IS NOT NULL AND destination_country IN ('NATION_4', 'NATION_9')
        GROUP BY 1, 2, 3, 4, 5"""
    ),
    "flow_counts_pairs_first": sql("SELECT * FROM flow_counts"),
    "flow_counts_spread_lookup": sql("SELECT * FROM flow_counts"),
    "flow_counts_by_origin": sql(
        "SELECT * FROM flow_counts WHERE origin_country IN ('NATION_3', 'NATION_7')"
    ),
    "flow_counts_to_country": sql(DAILY.format(where="AND destination_country = 'NATION_9'")),
}
