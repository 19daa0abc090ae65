"""Series with gaps and falls, and answers for every range of months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.checks.mart_checks import JOINED, cases, joined, pairs
from tallyflow.checks.tables import RETAIL, reports, sql
from tallyflow.functions.calendar import day_text
from tallyflow.operators.rollups import area_day_totals
from tallyflow.plans.range_index import correlation_index, range_index
from tallyflow.plans.snapshots import area_day_table, area_month_table, total_resets
from tallyflow.session import staged


def sparse_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three days in five."""
    return reports(spark, sf_dir).filter(F.dayofmonth("stamp") % 5 > 1)


def days_with_gaps(gaps: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = area_day_table(sparse_reports(spark, sf_dir), RETAIL, gaps=gaps)
        return days.withColumn("date", day_text(F.col("date")))

    return query


def days_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = area_day_table(reports(spark, sf_dir), RETAIL, resets="carry")
    return days.withColumn("date", day_text(F.col("date")))


def months_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_month_table(reports(spark, sf_dir), RETAIL, closing="last", resets="carry")


def falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = total_resets(area_day_totals(reports(spark, sf_dir), RETAIL), RETAIL)
    return events.withColumn("date", day_text(F.col("date")))


def every_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows per origin and peaks per country, for all pairs of months."""
    flows = range_index(pairs(spark, sf_dir), ["origin_country"], "flight_count")
    peaks = range_index(cases(spark, sf_dir), ["country"], "Confirmed_monthly_new")
    columns = ["range_start", "range_end"]
    totals = flows.totals(flows.all_ranges())
    totals = totals.select(F.lit("flows").alias("map"), *columns, F.col("origin_country").alias("country"), F.col("flight_count").alias("value"))
    largest = peaks.peaks(peaks.all_ranges())
    return totals.unionByName(largest.select(F.lit("peaks").alias("map"), *columns, "country", F.col("Confirmed_monthly_new").alias("value")))


def every_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of new cases and flows by country, for all pairs of months."""
    months = staged(joined(spark, sf_dir), "joined")
    index = correlation_index(months, "Confirmed_monthly_new", "flight_count", ["country"])
    asked = range_index(months, ["country"], "flight_count").all_ranges()
    rows = index.correlations(asked)
    return rows.withColumn("r", F.round("r", 6) + F.lit(0.0))


QUERIES = {
    "snapshot_daily_gaps_carried": days_with_gaps("carry"),
    "snapshot_daily_gaps_spread": days_with_gaps("spread"),
    "snapshot_daily_resets": days_with_resets,
    "snapshot_monthly_resets": months_with_resets,
    "snapshot_reset_events": falls,
    "range_index_all_pairs": every_range,
    "range_correlation_all_pairs": every_correlation,
}

MEASURES = {m: m.lower() for m in RETAIL.measures}
BY_DAY = "WINDOW w AS (PARTITION BY area ORDER BY day)"


def gap_sql(value: str) -> str:
    """``value`` makes the total of a day from x0, d0, x1 and d1, the known ones on both sides."""
    known = ", ".join(
        f"""last_value({x} IGNORE NULLS) OVER p AS {x}0, last_value(CASE WHEN {x} IS NOT NULL THEN day END IGNORE NULLS) OVER p AS {x}_d0,
        first_value({x} IGNORE NULLS) OVER f AS {x}1, first_value(CASE WHEN {x} IS NOT NULL THEN day END IGNORE NULLS) OVER f AS {x}_d1"""
        for x in MEASURES.values()
    )
    filled = ", ".join(f'{value.format(x=x)} AS "{m}_cumulative"' for m, x in MEASURES.items())
    changes = ", ".join(f'"{m}_cumulative" - lag("{m}_cumulative") OVER w AS "{m}_daily_new"' for m in MEASURES)
    return sql(f"""
        SELECT strftime(day, '%Y-%m-%d') AS date, area, reported,
               {", ".join(f'"{m}_cumulative"' for m in MEASURES)}, {changes}
        FROM (SELECT day, area, reported, {filled} FROM (
            SELECT *, {known} FROM (
                SELECT area, day, s.area IS NOT NULL AS reported, confirmed, deaths, recovered, active FROM (
                    SELECT area, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
                    FROM totals WHERE year(day) BETWEEN 1996 AND 2000 AND day(day) % 5 > 1 GROUP BY area) AS c
                LEFT JOIN (SELECT * FROM totals WHERE day(day) % 5 > 1) AS s USING (area, day)) AS j
            WINDOW p AS (PARTITION BY area ORDER BY day ROWS UNBOUNDED PRECEDING),
                   f AS (PARTITION BY area ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS k) AS v
        {BY_DAY}""")


VALID = "(SELECT * FROM totals WHERE year(day) BETWEEN 1996 AND 2000) AS valid"
DROPS = ", ".join(
    f"""greatest(last_value({x} IGNORE NULLS) OVER (PARTITION BY area ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {x}, 0) AS {x}_drop"""
    for x in MEASURES.values()
)
MONOTONE = f"""(
    SELECT day, area, {", ".join(
        f'CAST({x} + sum(coalesce({x}_drop, 0)) OVER (PARTITION BY area ORDER BY day) AS BIGINT) AS "{m}_cumulative"'
        for m, x in MEASURES.items())}
    FROM (SELECT *, {DROPS} FROM {VALID}) AS d) AS monotone"""
MONOTONE_DAYS = f"""(
    SELECT *, {", ".join(f'"{m}_cumulative" - lag("{m}_cumulative") OVER w AS "{m}_daily_new"' for m in MEASURES)}
    FROM {MONOTONE} {BY_DAY}) AS days_"""
PAIRS = "(SELECT a.month AS s, b.month AS e FROM {m} AS a JOIN {m} AS b ON a.month <= b.month)"


def calendar(table: str, month: str) -> str:
    return f"""(SELECT strftime(unnest(generate_series(min(strptime({month} || '-01', '%Y-%m-%d')),
        max(strptime({month} || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM {table})"""


SQL = {
    "snapshot_daily_gaps_carried": gap_sql("{x}0"),
    "snapshot_daily_gaps_spread": gap_sql(
        "{x}0 + coalesce(({x}1 - {x}0) * (day - {x}_d0) // greatest({x}_d1 - {x}_d0, 1), 0)"
    ),
    "snapshot_daily_resets": sql(f"""
        SELECT strftime(day, '%Y-%m-%d') AS date, * EXCLUDE (day) FROM {MONOTONE_DAYS}"""),
    "snapshot_monthly_resets": sql(f"""
        SELECT strftime(day, '%Y-%m') AS year_month, area,
               {", ".join(f'arg_max_null("{m}_cumulative", day) AS "{m}_cumulative"' for m in MEASURES)},
               {", ".join(f'CAST(sum("{m}_daily_new") AS BIGINT) AS "{m}_monthly_new"' for m in MEASURES)}
        FROM {MONOTONE_DAYS} GROUP BY 1, 2"""),
    "snapshot_reset_events": sql(" UNION ALL ".join(
        f"""SELECT area, strftime(day, '%Y-%m-%d') AS date, '{m}_cumulative' AS measure, CAST({x}_drop AS BIGINT) AS drop
        FROM (SELECT *, {DROPS} FROM {VALID}) AS d WHERE {x}_drop > 0"""
        for m, x in MEASURES.items()
    )),
    "range_index_all_pairs": sql(f"""
        SELECT 'flows' AS map, s AS range_start, e AS range_end, origin_country AS country, CAST(sum(flight_count) AS BIGINT) AS value
        FROM flow_counts JOIN {PAIRS.format(m=calendar('flow_counts', 'year_month'))} ON year_month BETWEEN s AND e GROUP BY ALL
        UNION ALL
        SELECT 'peaks', s, e, country, max("Confirmed_monthly_new")
        FROM cases JOIN {PAIRS.format(m=calendar('cases', 'month'))} ON month BETWEEN s AND e GROUP BY ALL"""),
    "range_correlation_all_pairs": sql(f"""
        SELECT s AS range_start, e AS range_end, country,
               CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) + 0.0 END AS r
        FROM (SELECT country, month, "Confirmed_monthly_new" AS x, flight_count AS y FROM {JOINED}) AS j
        JOIN {PAIRS.format(m=calendar('cases', 'month'))} ON month BETWEEN s AND e
        WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL"""),
}
