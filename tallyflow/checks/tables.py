"""The warehouse tables in the roles of reports, flows and dimensions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.lookups import place_table
from tallyflow.schemas import SnapshotSpec

# Order dates run from 1995 to 2001, so the first and the last year count as
# abnormal here.
RETAIL = SnapshotSpec(
    area="area", stamp="stamp", places=("segment",), first_year=1996, last_year=2000
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantity(condition: Column | None = None) -> Column:
    value = F.col("l_quantity").cast("long")
    return value if condition is None else F.when(condition, value)


def with_order(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items with their order, always by sort merge.

    Both sides grow with the data. Below the broadcast limit Spark would
    otherwise collect one of them, and it takes the line items for the smaller
    side once the orders carry a lookup of unknown size.
    """
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per line item; two of the four measures have gaps.

    The customer's nation is looked up per order, before the larger join.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.col("n_name").alias("area"),
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderdate").alias("stamp"),
        )
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        quantity().alias("Confirmed"),
        F.col("l_linenumber").alias("Deaths"),
        quantity(F.col("l_returnflag") == "R").alias("Recovered"),
        quantity(F.col("l_linestatus") == "O").alias("Active"),
    )
    return with_order(lines, orders).drop("l_orderkey", "o_orderkey")


def flows(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """One flow per line item. ``gaps`` leaves some days and origins unknown."""
    day, origin = F.col("l_shipdate"), F.col("l_suppkey")
    if gaps:
        day = F.when(F.col("l_discount") != 0.1, day)
        origin = F.when(F.col("l_tax") != 0.08, origin)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", day.alias("day"), origin.alias("origin")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("destination")
    )
    return with_order(lines, orders).select("day", "origin", "destination")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("country_code"), F.col("n_name").alias("country")
    )


def supplier_facilities(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """``gaps`` leaves the nation of suppliers in debt unknown."""
    nation = F.col("s_nationkey")
    if gaps:
        nation = F.when(F.col("s_acctbal") >= 0, nation)
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("icao"), nation.alias("country")
    )


def customer_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("icao"), F.col("c_nationkey").alias("country")
    )


def places(
    spark: SparkSession, sf_dir: str, gaps: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Origin and destination places."""
    known = codes(spark, sf_dir)
    return (
        place_table(supplier_facilities(spark, sf_dir, gaps), known),
        place_table(customer_facilities(spark, sf_dir), known),
    )


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports; one priority has no date, one has numbers as areas."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate")).alias(
                "stamp"
            ),
            F.when(F.col("o_orderpriority") == "5-LOW", F.col("c_nationkey").cast("string"))
            .otherwise(F.col("c_mktsegment"))
            .alias("area"),
            F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice")).alias("price"),
        )
    )


# The same roles in SQL. Each entry may use the ones before it.
CTES = {
    "reports": """
        SELECT n_name AS area, c_mktsegment AS segment, o_orderdate AS stamp,
               CAST(l_quantity AS BIGINT) AS "Confirmed",
               CAST(l_linenumber AS BIGINT) AS "Deaths",
               CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END AS "Recovered",
               CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END AS "Active"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "totals": """
        SELECT CAST(stamp AS DATE) AS day, area,
               CAST(sum("Confirmed") AS BIGINT) AS confirmed,
               CAST(sum("Deaths") AS BIGINT) AS deaths,
               CAST(sum("Recovered") AS BIGINT) AS recovered,
               CAST(sum("Active") AS BIGINT) AS active,
               count(*) AS report_rows
        FROM reports GROUP BY 1, 2""",
    "days": """
        SELECT day, area, confirmed, deaths, recovered, active,
               confirmed - lag(confirmed) OVER w AS new_confirmed,
               deaths - lag(deaths) OVER w AS new_deaths,
               recovered - lag(recovered) OVER w AS new_recovered,
               active - lag(active) OVER w AS new_active
        FROM totals WHERE year(day) BETWEEN 1996 AND 2000
        WINDOW w AS (PARTITION BY area ORDER BY day)""",
    "months": """
        SELECT strftime(day, '%Y-%m') AS year_month, area,
               max(confirmed) AS "Confirmed_cumulative", max(deaths) AS "Deaths_cumulative",
               max(recovered) AS "Recovered_cumulative", max(active) AS "Active_cumulative",
               CAST(sum(new_confirmed) AS BIGINT) AS "Confirmed_monthly_new",
               CAST(sum(new_deaths) AS BIGINT) AS "Deaths_monthly_new",
               CAST(sum(new_recovered) AS BIGINT) AS "Recovered_monthly_new",
               CAST(sum(new_active) AS BIGINT) AS "Active_monthly_new"
        FROM days GROUP BY 1, 2""",
    # Reports of a day in the middle of a month start the second batch, so
    # that month is in both.
    "batch_rows": """
        SELECT strftime(day, '%Y-%m') AS year_month, area, day >= DATE '1998-09-16' AS second_batch,
               max(confirmed) AS c, max(deaths) AS d, max(recovered) AS r, max(active) AS a
        FROM totals WHERE year(day) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3""",
    "merged": """
        SELECT year_month AS month, area AS country,
               CAST(coalesce(sum(c), 0) AS BIGINT) AS "Confirmed_cumulative",
               CAST(coalesce(sum(d), 0) AS BIGINT) AS "Deaths_cumulative",
               CAST(coalesce(sum(r), 0) AS BIGINT) AS "Recovered_cumulative",
               CAST(coalesce(sum(a), 0) AS BIGINT) AS "Active_cumulative"
        FROM batch_rows GROUP BY 1, 2""",
    "cases": """
        SELECT *,
               "Confirmed_cumulative" - lag("Confirmed_cumulative") OVER w AS "Confirmed_monthly_new",
               "Deaths_cumulative" - lag("Deaths_cumulative") OVER w AS "Deaths_monthly_new",
               "Recovered_cumulative" - lag("Recovered_cumulative") OVER w AS "Recovered_monthly_new",
               "Active_cumulative" - lag("Active_cumulative") OVER w AS "Active_monthly_new"
        FROM merged WINDOW w AS (PARTITION BY country ORDER BY month)""",
    "cases_long": " UNION ALL ".join(
        f"""
        SELECT country, month, '{m}_{kind}' AS stat, "{m}_{kind}" AS value FROM cases"""
        for m in ("Confirmed", "Deaths", "Recovered", "Active")
        for kind in ("cumulative", "monthly_new")
    ),
    "flows": """
        SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS origin, o_custkey AS destination
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "mapped": """
        SELECT day, strftime(day, '%Y-%m') AS year_month,
               s_nationkey AS origin_country_code, o.n_name AS origin_country,
               c_nationkey AS destination_country_code, d.n_name AS destination_country
        FROM flows JOIN supplier ON origin = s_suppkey JOIN customer ON destination = c_custkey
        JOIN nation o ON s_nationkey = o.n_nationkey
        JOIN nation d ON c_nationkey = d.n_nationkey""",
    "flow_counts": """
        SELECT year_month, origin_country, origin_country_code, destination_country,
               destination_country_code, count(*) AS flight_count
        FROM mapped WHERE origin_country_code <> destination_country_code
        GROUP BY 1, 2, 3, 4, 5""",
    "gap_flows": """
        SELECT CASE WHEN l_discount <> 0.1 THEN CAST(l_shipdate AS DATE) END AS day,
               CASE WHEN l_tax <> 0.08 THEN l_suppkey END AS origin,
               o_custkey AS destination
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "gap_suppliers": """
        SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_nationkey END AS s_nationkey
        FROM supplier""",
    "gap_mapped": """
        SELECT day, strftime(day, '%Y-%m') AS year_month,
               s_suppkey AS origin_icao, s_nationkey AS origin_country_code,
               o.n_name AS origin_country, c_custkey AS destination_icao,
               c_nationkey AS destination_country_code, d.n_name AS destination_country
        FROM gap_flows LEFT JOIN gap_suppliers ON origin = s_suppkey
        LEFT JOIN customer ON destination = c_custkey
        LEFT JOIN nation o ON s_nationkey = o.n_nationkey
        LEFT JOIN nation d ON c_nationkey = d.n_nationkey""",
    "dated_orders": """
        SELECT o_orderkey,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS stamp,
               CASE WHEN o_orderpriority = '5-LOW' THEN CAST(c_nationkey AS VARCHAR)
                    ELSE c_mktsegment END AS area,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS price
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "orders_by_nation": """
        SELECT n_name AS area, o_orderdate AS day,
               CAST(floor(o_totalprice) AS BIGINT) AS price
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
}


def sql(select: str) -> str:
    """The SELECT with the CTEs it needs in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed and body is not text:
                visit(body)
                needed.append(name)

    visit(select)
    if not needed:
        return select
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH {parts}\n{select}"
