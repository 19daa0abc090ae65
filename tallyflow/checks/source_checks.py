"""Readers and writers: whole tables written to files and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.checks.tables import (
    RETAIL,
    codes,
    flows,
    places,
    reports,
    sql,
    supplier_facilities,
    table,
)
from tallyflow.functions.calendar import day_text, month_of_number
from tallyflow.operators.lookups import place_table
from tallyflow.operators.quality import first_rows
from tallyflow.operators.rollups import area_day_totals
from tallyflow.plans.flows import count_flows, flow_order, map_flows
from tallyflow.plans.incremental import refresh_totals
from tallyflow.plans.snapshots import area_month_table
from tallyflow.session import stage_path
from tallyflow.sources import readers
from tallyflow.sources.batches import flow_glob, report_day
from tallyflow.sources.layouts import (
    file_headers,
    key_of,
    read_reports_by_header,
    read_routed,
    routed,
    unknown_headers,
)
from tallyflow.sources.sinks import RESULT_PARTITIONS, land_by_month, write_batch, write_csv

ORDER_COLUMNS = "o_orderkey LONG, o_custkey LONG, o_totalprice DOUBLE, order_day STRING"


def order_file(spark: SparkSession, sf_dir: str, defects: bool = False) -> str:
    """All orders as CSV. ``defects`` writes the customer of urgent ones as text."""
    path = stage_path(spark, "orders-csv")
    customer = F.col("o_custkey").cast("string")
    if defects:
        urgent = F.col("o_orderpriority") == "1-URGENT"
        customer = F.when(urgent, F.concat(F.lit("customer "), customer)).otherwise(customer)
    write_csv(
        table(spark, sf_dir, "orders").select(
            "o_orderkey",
            customer.alias("o_custkey"),
            "o_totalprice",
            day_text(F.col("o_orderdate")).alias("order_day"),
        ),
        path,
    )
    return path


def declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_declared(spark, order_file(spark, sf_dir), ORDER_COLUMNS)


def malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_declared(
        spark,
        order_file(spark, sf_dir, defects=True),
        ORDER_COLUMNS,
        mode="DROPMALFORMED",
        whole_rows=True,
    )


def malformed_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_with_rejects(spark, order_file(spark, sf_dir, defects=True), ORDER_COLUMNS)
    return readers.scan_profile(rows)


def report_files(spark: SparkSession, sf_dir: str) -> str:
    """All orders as reports: a third each with 14, 12 and 6 fields."""
    folder = stage_path(spark, "mixed-reports")
    empty = F.lit(None).cast("string")
    orders = table(spark, sf_dir, "orders")
    full = [
        empty.alias("FIPS"),
        F.col("o_orderpriority").alias("Admin2"),
        F.col("o_orderkey").cast("string").alias("Province_State"),
        F.col("o_orderstatus").alias("Country_Region"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Last_Update"),
        empty.alias("Lat"),
        empty.alias("Long_"),
        F.floor("o_totalprice").cast("int").alias("Confirmed"),
        F.col("o_custkey").cast("int").alias("Deaths"),
        empty.alias("Recovered"),
        empty.alias("Active"),
        F.concat_ws(", ", "o_orderpriority", "o_orderstatus").alias("Combined_Key"),
        empty.alias("Incident_Rate"),
        empty.alias("Case_Fatality_Ratio"),
    ]
    for third, fields in enumerate((14, 12, 6)):
        part = orders.filter(F.pmod("o_orderkey", F.lit(3)) == third)
        write_csv(part.select(*full[:fields]), f"{folder}/0{third + 1}-01-2001.csv")
    return folder


def mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_reports(spark, report_files(spark, sf_dir))
    return rows.select(
        F.col("Province_State").cast("long").alias("o_orderkey"),
        day_text(F.col("Last_Update")).alias("day"),
        F.col("Country_Region").alias("area"),
        "Confirmed",
        "Deaths",
        "Combined_Key",
    )


def mixed_layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected rows per file and layout."""
    rows = readers.read_reports(spark, report_files(spark, sf_dir), rejects=True)
    named_file = F.regexp_extract(schemas.SOURCE, "/([0-9]{2})-01-2001[.]csv/", 1)
    return readers.layout_profile(rows.withColumn(schemas.SOURCE, named_file)).select(
        F.col(schemas.SOURCE).alias("file"), F.col("_layout").alias("layout"), "report_rows", "dated_rows"
    )


# Headers as found in files: of early 2020, of spring 2020, two of later months in
# other orders or with other names, and one that is no report.
ROUTED = {
    "01-22-2020": ("\ufeffProvince/State", "Country/Region", "Last Update", "Confirmed", "Deaths", "Recovered"),
    "03-01-2020": ("Province/State", "Country/Region", "Last Update", "Confirmed", "Deaths", "Recovered", "Latitude", "Longitude"),
    "04-01-2020": ("FIPS", "Admin2", "Province_State", "Country_Region", "Last_Update", "Lat", "Long_", "Confirmed", "Deaths",
                   "Recovered", "Active", "Combined_Key"),
    "06-01-2020": ("FIPS", "Admin2", "Province_State", "Country_Region", "Last_Update", "Lat", "Long_", "Confirmed", "Deaths",
                   "Recovered", "Active", "Combined_Key", "Incidence_Rate", "Case-Fatality_Ratio"),
    "2020-12-01": ("Country_Region", "Last_Update", "Deaths", "Confirmed", "Province_State", "Source", "FIPS", "Admin2",
                   "Lat", "Long_", "Recovered", "Active", "Incident_Rate", "Case_Fatality_Ratio"),
    "12-02-2020": ("Region", "Updated", "Count"),
}


def headed_files(spark: SparkSession, sf_dir: str) -> str:
    """All orders as reports, a sixth under each of the headers."""
    folder = stage_path(spark, "headed-reports")
    orders = table(spark, sf_dir, "orders")
    key, empty = F.col("o_orderkey"), F.lit(None).cast("string")
    stamp = F.when(key % 12 == 0, F.date_format("o_orderdate", "M/d/yyyy H:mm")).otherwise(
        F.when(key % 6 == 0, F.date_format("o_orderdate", "M/d/yy H:mm")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
        )
    )
    # One in 35 of the rows has a time that cannot be read.
    stamp = F.when(key % 35 == 0, F.lit("last week")).otherwise(stamp)
    values = {
        "provincestate": key.cast("string"),
        "countryregion": F.col("o_orderstatus"),
        "region": F.col("o_orderstatus"),
        "lastupdate": stamp,
        "updated": stamp,
        "confirmed": F.floor("o_totalprice"),
        "count": F.floor("o_totalprice"),
        "deaths": F.col("o_custkey"),
        "active": key % 97,
        "combinedkey": F.concat_ws(", ", "o_orderpriority", "o_orderstatus"),
        "incidencerate": F.lit("0.5"),
    }
    for part, (name, header) in enumerate(ROUTED.items()):
        columns = [values.get(key_of(c), empty).alias(c) for c in header]
        write_csv(orders.filter(F.pmod("o_orderkey", F.lit(6)) == part).select(*columns), f"{folder}/{name}.csv")
    return folder


def routed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all layouts in one."""
    rows = read_reports_by_header(spark, headed_files(spark, sf_dir))
    return rows.select(
        F.col("Province_State").cast("long").alias("o_orderkey"),
        F.date_format("Last_Update", "yyyy-MM-dd").alias("day"),
        F.col("Country_Region").alias("area"),
        "Confirmed",
        "Deaths",
        "Active",
        "Combined_Key",
        F.col("Incident_Rate").cast("double").alias("rate"),
    )


def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected rows by file and layout, and the headers that no layout fits."""
    found = routed(file_headers(spark, f"{headed_files(spark, sf_dir)}/*.csv"))
    day = lambda file: F.regexp_extract(file, "/([0-9-]+)[.]csv/", 1)
    counts = readers.layout_profile(read_routed(spark, found)).withColumn("file", day(F.col(schemas.SOURCE)))
    counts = counts.groupBy("file", F.col("_layout").alias("layout")).agg(
        F.sum("report_rows").alias("report_rows"), F.sum("dated_rows").alias("dated_rows")
    )
    odd = unknown_headers(spark, found).select(day(F.col("file")).alias("file"), "header").distinct()
    return counts.join(odd, "file", "left")


def report_columns(value: Column, stamp: Column | None = None) -> list[Column]:
    """An order as a report of the present layout; its key is the place."""
    empty = F.lit(None).cast("string")
    return [
        empty.alias("FIPS"),
        F.col("o_orderkey").cast("string").alias("Admin2"),
        F.col("o_orderpriority").alias("Province_State"),
        F.col("o_orderstatus").alias("Country_Region"),
        F.date_format("o_orderdate" if stamp is None else stamp, "yyyy-MM-dd HH:mm:ss").alias("Last_Update"),
        empty.alias("Lat"),
        empty.alias("Long_"),
        value.cast("int").alias("Confirmed"),
        F.col("o_custkey").cast("int").alias("Deaths"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).alias("Recovered"),
        empty.alias("Active"),
        F.col("o_orderpriority").alias("Combined_Key"),
        empty.alias("Incident_Rate"),
        empty.alias("Case_Fatality_Ratio"),
    ]


def price() -> Column:
    return F.floor("o_totalprice")


def latest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that later files correct, or repeat with an old value or an earlier time."""
    folder = stage_path(spark, "revised-reports")
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    later = F.when(key % 3 == 0, price() + 1).otherwise(price())
    for name, rows in {
        "12-29-2001": orders.select(*report_columns(price())),
        "2001-12-30": orders.filter(key % 3 < 2).select(*report_columns(later)),
        "12-31-2001": orders.filter(key % 5 == 0).select(*report_columns(later * 2))
        # Repeated in the newest file, but older than the row beside it.
        .unionByName(orders.filter(key % 10 == 0).select(*report_columns(F.lit(1), F.to_date("o_orderdate")))),
    }.items():
        write_csv(rows, f"{folder}/{name}.csv")
    rows = readers.read_reports(spark, folder, rejects=True)
    totals = area_day_totals(rows, schemas.SnapshotSpec(), revisions="latest", version=report_day(F.col(schemas.SOURCE)))
    return totals.withColumn("date", day_text(F.col("date")))


def incremental_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a run over all files, and a second one over a changed, a new and a deleted file."""
    folder, store = stage_path(spark, "daily-files"), stage_path(spark, "day-store")
    orders = table(spark, sf_dir, "orders")
    part = F.col("o_orderkey") % 4

    def write(name: str, rows: DataFrame, value: Column) -> None:
        write_csv(rows.select(*report_columns(value)), f"{folder}/{name}.csv")

    def refresh() -> DataFrame:
        return refresh_totals(spark, f"{folder}/*.csv", store, lambda files: readers.read_report_files(spark, files)).totals

    for day in range(3):
        write(f"12-0{day + 1}-2001", orders.filter(part == day), price())
    refresh()
    write("12-02-2001", orders.filter((part == 1) & (F.col("o_orderkey") % 3 > 0)), price() * 2)
    write("12-03-2001", orders.filter("false"), price())
    write("12-04-2001", orders.filter(part == 3), price())
    totals = refresh()
    return totals.withColumn("date", day_text(F.col("date")))


def text_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a day as in a flow file, and a column no one reads."""
    return flows(spark, sf_dir).select(
        F.concat(day_text(F.col("day")), F.lit(" 00:00:00+00:00")).alias("day"),
        F.lit("unused").alias("callsign"),
        "origin",
        "destination",
    )


def gzip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "flows-gzip")
    path = f"{folder}/flightlist_19950101_20011231.csv.gz"
    text_flows(spark, sf_dir).write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_flows(spark, folder).select(
        F.substring("day", 1, 10).alias("day"),
        F.col("origin").cast("long").alias("origin"),
        F.col("destination").cast("long").alias("destination"),
    )


def missing_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch without files adds no rows to the customers."""
    absent = readers.read_declared(
        spark,
        f"{stage_path(spark, 'absent')}/*.csv",
        "c_custkey LONG, c_name STRING",
        missing_ok=True,
    )
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").unionByName(absent)


def batch_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one year, picked by name from files of all months."""
    folder = stage_path(spark, "flows-by-list")
    rows = text_flows(spark, sf_dir)
    stem = F.replace(F.substring("day", 1, 7), F.lit("-"), F.lit(""))
    (
        rows.withColumn("flightlist", F.concat(stem, F.lit("01_"), stem, F.lit("28")))
        .hint("rebalance", F.col("flightlist"))
        .write.partitionBy("flightlist")
        .option("header", True)
        .csv(folder)
    )
    path = f"{folder}/{flow_glob('1996', prefix='flightlist=', suffix='')}"
    return readers.read_text_columns(spark, path, schemas.FLOW_COLUMNS).select(
        F.substring("day", 1, 10).alias("day"),
        F.col("origin").cast("long").alias("origin"),
        F.col("destination").cast("long").alias("destination"),
    )


def landed_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows landed by month, then read with a partition filter."""
    path = stage_path(spark, "flows-landed")
    rows = flows(spark, sf_dir)
    land_by_month(rows, path, "day")
    return (
        readers.read_partitioned(spark, path, rows.schema, ["year_month"])
        .filter(F.col("year_month").between("1997-03", "1997-08"))
        .groupBy("year_month", "origin")
        .agg(F.count("*").alias("flights"))
    )


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow counts through the Parquet sink; a rerun replaces what was there."""
    path = stage_path(spark, "flow-counts")
    counts = count_flows(map_flows(flows(spark, sf_dir), *places(spark, sf_dir)), "destination", "year_month")
    for _ in range(2):
        write_batch(counts, path, batch="all", sort=flow_order("destination", "year_month"))
    # A second batch, run again without any row, leaves none behind.
    one_month = counts.filter(F.col("year_month") == "1997-03")
    for rows in (one_month, one_month.limit(0)):
        write_batch(rows, path, batch="199703")
    written = readers.read_partitioned(spark, path, counts.schema, RESULT_PARTITIONS)
    return written.drop(*RESULT_PARTITIONS)


def csv_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly table through the CSV export and its reader."""
    path = stage_path(spark, "months-csv")
    months = area_month_table(reports(spark, sf_dir), RETAIL)
    write_csv(
        months.withColumnRenamed("area", "Country_Region"),
        path,
        sort=["Country_Region", "year_month"],
    )
    return readers.read_monthly_cases(spark, path).drop("source_file")


def place_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dimensions as CSV files, read, renamed, narrowed and joined."""
    facility_path, code_path = stage_path(spark, "facilities"), stage_path(spark, "codes")
    write_csv(
        supplier_facilities(spark, sf_dir).withColumn("elevation", F.lit(0)), facility_path
    )
    write_csv(
        codes(spark, sf_dir)
        .withColumnsRenamed(
            {"country": schemas.CODE_NAME_COLUMN, "country_code": schemas.CODE_COLUMN}
        )
        .withColumn("Numeric code", F.lit("000")),
        code_path,
    )
    return place_table(
        readers.read_facilities(spark, facility_path), readers.read_codes(spark, code_path)
    )


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        day_text(F.col("o_orderdate")).alias("day"), "o_orderkey", "o_totalprice"
    )
    return first_rows(orders, ["day", "o_orderkey"], 10)


def numbered_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months such as 199607 as text, per order."""
    number = F.date_format("o_orderdate", "yyyyMM").cast("int")
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", number.alias("number"))
        .select("o_orderkey", month_of_number(F.col("number")).alias("month"))
    )


QUERIES = {
    "csv_scan_declared_schema": declared_scan,
    "csv_scan_drop_malformed": malformed_dropped,
    "csv_scan_profile": malformed_counted,
    "csv_scan_mixed_layouts": mixed_layouts,
    "csv_scan_layout_counts": mixed_layout_counts,
    "csv_scan_routed_layouts": routed_layouts,
    "csv_scan_routed_counts": routed_counts,
    "area_day_latest_revision": latest_revisions,
    "incremental_run_equals_full": incremental_totals,
    "gzip_csv_scan": gzip_scan,
    "scan_missing_batch": missing_batch,
    "batch_glob_select": batch_selected,
    "land_by_month": landed_month,
    "parquet_sink_roundtrip": result_table,
    "csv_sink_roundtrip": csv_result,
    "dim_rename_project": place_dimension,
    "preview_first_rows": first_orders,
    "yyyymm_int_to_month": numbered_months,
}

SQL = {
    "csv_scan_declared_schema": """
        SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day
        FROM orders""",
    "csv_scan_drop_malformed": """
        SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day
        FROM orders WHERE o_orderpriority <> '1-URGENT'""",
    "csv_scan_profile": """
        SELECT count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS kept,
               count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS rejected,
               count(o_orderkey) FILTER (WHERE o_orderpriority <> '1-URGENT') AS o_orderkey,
               count(o_custkey) FILTER (WHERE o_orderpriority <> '1-URGENT') AS o_custkey,
               count(o_totalprice) FILTER (WHERE o_orderpriority <> '1-URGENT') AS o_totalprice,
               count(o_orderdate) FILTER (WHERE o_orderpriority <> '1-URGENT') AS order_day
        FROM orders""",
    "csv_scan_mixed_layouts": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS area,
               CAST(floor(o_totalprice) AS INTEGER) AS "Confirmed", CAST(o_custkey AS INTEGER) AS "Deaths",
               o_orderpriority || ', ' || o_orderstatus AS "Combined_Key"
        FROM orders WHERE o_orderkey % 3 < 2""",
    "csv_scan_layout_counts": """
        SELECT '0' || (o_orderkey % 3 + 1) AS file, CASE o_orderkey % 3 WHEN 0 THEN 14 WHEN 1 THEN 12 ELSE 0 END AS layout,
               count(*) AS report_rows, count(*) FILTER (WHERE o_orderkey % 3 < 2) AS dated_rows
        FROM orders GROUP BY 1, 2""",
    "csv_scan_routed_layouts": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS area,
               CAST(floor(o_totalprice) AS INTEGER) AS "Confirmed", CAST(o_custkey AS INTEGER) AS "Deaths",
               CASE WHEN o_orderkey % 6 BETWEEN 2 AND 3 THEN CAST(o_orderkey % 97 AS INTEGER)
                    WHEN o_orderkey % 6 = 4 THEN CAST(o_orderkey % 97 AS INTEGER) END AS "Active",
               CASE WHEN o_orderkey % 6 BETWEEN 2 AND 3 THEN o_orderpriority || ', ' || o_orderstatus END AS "Combined_Key",
               CASE WHEN o_orderkey % 6 = 3 THEN CAST(0.5 AS DOUBLE) END AS rate
        FROM orders WHERE o_orderkey % 6 < 5 AND o_orderkey % 35 <> 0""",
    "csv_scan_routed_counts": """
        SELECT ['01-22-2020', '03-01-2020', '04-01-2020', '06-01-2020', '2020-12-01', '12-02-2020'][o_orderkey % 6 + 1] AS file,
               CASE WHEN o_orderkey % 6 = 5 OR o_orderkey % 35 = 0 THEN 0
                    ELSE [6, 8, 12, 14, 14][o_orderkey % 6 + 1] END AS layout,
               count(*) AS report_rows, count(*) FILTER (WHERE o_orderkey % 6 < 5 AND o_orderkey % 35 <> 0) AS dated_rows,
               CASE WHEN o_orderkey % 6 = 5 THEN 'Region,Updated,Count' END AS header
        FROM orders GROUP BY ALL""",
    "area_day_latest_revision": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS "Country_Region",
               CAST(sum((floor(o_totalprice) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)
                        * CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS "Confirmed",
               CAST(sum(o_custkey) AS BIGINT) AS "Deaths",
               CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS BIGINT) AS "Recovered",
               CAST(NULL AS BIGINT) AS "Active", count(*) AS report_rows, CAST(0 AS BIGINT) AS rejected_rows,
               CAST(sum(CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END
                        + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS superseded_rows
        FROM orders GROUP BY 1, 2""",
    "incremental_run_equals_full": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS "Country_Region",
               CAST(sum(floor(o_totalprice) * CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS "Confirmed",
               CAST(sum(o_custkey) AS BIGINT) AS "Deaths",
               CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS BIGINT) AS "Recovered",
               CAST(NULL AS BIGINT) AS "Active", count(*) AS report_rows, CAST(0 AS BIGINT) AS rejected_rows
        FROM orders WHERE o_orderkey % 4 <> 2 AND (o_orderkey % 4 <> 1 OR o_orderkey % 3 > 0) GROUP BY 1, 2""",
    "gzip_csv_scan": sql(
        "SELECT strftime(day, '%Y-%m-%d') AS day, origin, destination FROM flows"
    ),
    "scan_missing_batch": "SELECT c_custkey, c_name FROM customer",
    "batch_glob_select": sql(
        """SELECT strftime(day, '%Y-%m-%d') AS day, origin, destination
        FROM flows WHERE year(day) = 1996"""
    ),
    "land_by_month": sql(
        """SELECT strftime(day, '%Y-%m') AS year_month, origin, count(*) AS flights FROM flows
        WHERE day >= DATE '1997-03-01' AND day < DATE '1997-09-01' GROUP BY 1, 2"""
    ),
    "parquet_sink_roundtrip": sql("SELECT * FROM flow_counts"),
    "csv_sink_roundtrip": sql('SELECT * RENAME (area AS "Country_Region") FROM months'),
    "dim_rename_project": """
        SELECT CAST(s_suppkey AS VARCHAR) AS icao, CAST(s_nationkey AS VARCHAR) AS country_code,
               n_name AS country
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "preview_first_rows": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey, o_totalprice
        FROM orders ORDER BY 1, 2 LIMIT 10""",
    "yyyymm_int_to_month": """
        SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
}
