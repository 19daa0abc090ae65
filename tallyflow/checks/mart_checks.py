"""Recombined batches, joins of both families, views and the whole run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.checks.snapshot_checks import PLAIN, QUALITY_LINES, missing
from tallyflow.checks.tables import (
    RETAIL,
    codes,
    customer_facilities,
    flows,
    places,
    reports,
    sql,
    supplier_facilities,
    table,
)
from tallyflow.functions.calendar import day_text
from tallyflow.functions.text import all_digits, monthly_name, slug, title_label
from tallyflow.operators.filters import renamed_areas
from tallyflow.operators.reshape import long_days, long_stats, stat_rows, union_by_name
from tallyflow.operators.rollups import (
    area_month_series,
    area_months,
    correlation,
    default_range,
    month_domain,
    recombined,
)
from tallyflow.plans.batch_job import BatchInputs, run_batch
from tallyflow.plans.flows import count_flows, map_flows
from tallyflow.plans.marts import (
    cases_with_flows,
    destination_flows,
    flow_hierarchy,
    marts,
    marts_from_csv,
    marts_from_results,
    monthly_cases,
    pair_flows,
    series_marts,
    with_known_names,
)
from tallyflow.plans.snapshots import area_day_table, area_month_table
from tallyflow.plans.views import (
    country_peaks,
    map_scales,
    opening_range,
    origin_flows,
    series_map_views,
    stat_correlation,
    time_series,
)
from tallyflow.session import stage_path, staged
from tallyflow.sources.readers import (
    alias_table,
    read_end_flows,
    read_partitioned,
    read_wide_series,
)
from tallyflow.sources.sinks import RESULT_PARTITIONS, write_batch, write_csv
from tallyflow.streaming.joined_months import append_rows, streamed_cases_with_flows

SECOND_BATCH = dt.date(1998, 9, 16)
START, END = "1997-02", "1999-06"
FOCUS = "NATION_2"
KEYS = ["country", "month"]


def in_batches(df: DataFrame, column: str) -> list[DataFrame]:
    """Two batches that meet in the middle of a month, so both hold that month."""
    cut = F.lit(SECOND_BATCH.isoformat()).cast("timestamp_ntz")
    return [df.filter(F.col(column) < cut), df.filter(F.col(column) >= cut)]


def case_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = in_batches(reports(spark, sf_dir), "stamp")
    return union_by_name([area_month_table(part, RETAIL) for part in parts])


def flow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = places(spark, sf_dir)
    return union_by_name(
        [
            count_flows(map_flows(part, *ends), "destination", "year_month")
            for part in in_batches(flows(spark, sf_dir), "day")
        ]
    )


def labelled(df: DataFrame, column: str) -> DataFrame:
    """Marks each row with its batch, so that one pass serves both batches."""
    second = F.col(column) >= F.lit(SECOND_BATCH)
    return df.withColumn("batch", F.when(second, "second").otherwise("first"))


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = area_day_table(reports(spark, sf_dir), RETAIL)
    return area_months(labelled(days, "date"), RETAIL, extra=["batch"])


def flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_flows(flows(spark, sf_dir), *places(spark, sf_dir))
    return count_flows(
        labelled(mapped, "day"), "destination", "year_month", extra=["batch"]
    )


def recombined_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_flows(flow_batches(spark, sf_dir))


def recombined_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["year_month", "area"]
    return recombined(case_batches(spark, sf_dir), keys, RETAIL.cumulative)


def recombined_cases_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["year_month", "area"]
    return recombined(case_batches(spark, sf_dir), keys, RETAIL.cumulative, combine="max")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_cases(case_rows(spark, sf_dir), RETAIL)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_flows(flow_rows(spark, sf_dir))


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return destination_flows(pairs(spark, sf_dir))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_with_flows(cases(spark, sf_dir), ends(spark, sf_dir))


def joined_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases_with_flows(cases(spark, sf_dir), ends(spark, sf_dir), FOCUS)


def long_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_stats(cases(spark, sf_dir), KEYS, RETAIL.month_stats)


def labelled_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stat_rows(cases(spark, sf_dir), "Deaths_monthly_new")
    return rows.withColumn("label", title_label(F.col("stat")))


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("area"),
            F.col("o_orderdate").alias("day"),
            F.floor("o_totalprice").alias("price"),
        )
    )


def wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per month of the orders, named like the days of a wide series."""
    orders = orders_by_nation(spark, sf_dir)
    month = F.trunc(F.to_date("day"), "month")
    first, last = orders.agg(F.min(month), F.max(month)).first()
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    numbers = [first.year * 12 + first.month - 1 + i for i in range(count)]
    months = [f"{n % 12 + 1}/1/{n // 12 % 100:02d}" for n in numbers]
    header = F.date_format(month, "M/d/yy")
    return (
        orders
        .withColumn("header", header)
        .groupBy("area")
        .pivot("header", months)
        .agg(F.sum("price"))
    )


def long_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_days(wide_orders(spark, sf_dir), area="area", value="price", day="day")
    return rows.withColumn("day", day_text(F.col("day")))


def wide_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Marts of a wide CSV series and of flows with numbered months."""
    path = stage_path(spark, "wide-series")
    wide = wide_orders(spark, sf_dir).withColumnRenamed("area", schemas.WIDE_SERIES_AREA)
    write_csv(
        wide.select(F.lit("").alias("Province/State"), "*", F.lit(0).alias("Lat"), F.lit(0).alias("Long")),
        path,
    )
    arrivals = ends(spark, sf_dir).select(
        F.replace("month", F.lit("-"), F.lit("")).cast("int").alias("month"),
        "end_country",
        F.col("flight_count").alias("flights"),
    )
    flow_path = stage_path(spark, "end-flows")
    write_csv(arrivals, flow_path)
    return series_marts(read_wide_series(spark, path), read_end_flows(spark, flow_path), FOCUS)


def wide_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both joined for one area."""
    return wide_tables(spark, sf_dir)["focus_with_flows"]


def wide_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows by destination and peaks by area, in a range."""
    views = series_map_views(wide_tables(spark, sf_dir), START, END)
    flows_map = views["flows"].select(F.lit("flows").alias("map"), F.col("end_country").alias("country"), F.col("flights").alias("value"))
    peaks_map = views["peaks"].select(F.lit("peaks").alias("map"), F.col(schemas.WIDE_SERIES_AREA).alias("country"), F.col("Confirmed").alias("value"))
    return flows_map.unionByName(peaks_map)


def month_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_month_series(orders_by_nation(spark, sf_dir), "area", "day", "price")


def month_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_month_series(
        orders_by_nation(spark, sf_dir), "area", "day", "price", how="max"
    )


def series_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_series(
        joined_focus(spark, sf_dir), "Deaths_cumulative", START, END, RETAIL
    )


def flows_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origin_flows(pairs(spark, sf_dir), START, END)


def peaks_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return country_peaks(cases(spark, sf_dir), START, END)


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_scales(pairs(spark, sf_dir), cases(spark, sf_dir))


def focus_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = stat_correlation(
        joined_focus(spark, sf_dir), "Confirmed_cumulative", START, END, RETAIL
    )
    return row.withColumn("r", F.round("r", 6))


def area_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = correlation(
        joined(spark, sf_dir), "Confirmed_monthly_new", "flight_count", by=["country"]
    )
    return rows.withColumn("r", F.round("r", 6))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_domain(pairs(spark, sf_dir))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default range with a cut that is present, and with none."""
    domain = staged(month_domain(pairs(spark, sf_dir)), "months")
    cut = default_range(domain, "1998-08").withColumn("cut", F.lit("1998-08"))
    absent = opening_range(domain).withColumn("cut", F.lit(schemas.DEFAULT_RANGE_END))
    return cut.unionByName(absent)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stat = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_cumulative"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        title_label(stat).alias("label"),
        monthly_name(stat).alias("monthly"),
        slug(F.array("p_name", "p_type", F.lit("*"))).alias("slug"),
        F.substring("p_brand", 7, 2).alias("brand_number"),
        all_digits(F.substring("p_brand", 7, 2)).cast("int").alias("is_number"),
    )


# A name that the codes table does not have, of a nation that it has.
FOREIGN = {"NATION_7": "Nation, 77"}


def batch_files(spark: SparkSession, sf_dir: str, defects: bool = False) -> BatchInputs:
    """All tables written in the layouts a batch run reads.

    ``defects`` leaves days and origins of some flows and the nation of some suppliers
    unknown, leaves out some facilities, and writes one nation by another name.
    """
    root = stage_path(spark, "batch-inputs")
    inputs = BatchInputs(
        f"{root}/reports", f"{root}/flights", f"{root}/airports.csv", f"{root}/countries.csv"
    )
    empty = F.lit(None).cast("string")
    write_csv(
        reports(spark, sf_dir).select(
            empty.alias("FIPS"),
            F.col("segment").alias("Admin2"),
            empty.alias("Province_State"),
            renamed_areas(F.col("area"), FOREIGN if defects else {}).alias("Country_Region"),
            F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("Last_Update"),
            empty.alias("Lat"),
            empty.alias("Long_"),
            *schemas.MEASURES,
            F.col("area").alias("Combined_Key"),
            empty.alias("Incident_Rate"),
            empty.alias("Case_Fatality_Ratio"),
        ),
        f"{inputs.reports}/12-31-2001.csv",
    )

    # Rows of a layout that is not known, to be rejected and counted.
    write_csv(
        table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(
            *[F.col("o_orderkey").cast("string").alias(f"c{i}") for i in range(6)]
        ),
        f"{inputs.reports}/12-30-2001.csv",
    )

    def key(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string")).alias(column)

    (
        flows(spark, sf_dir, gaps=defects)
        .select(
            F.concat(day_text(F.col("day")), F.lit(" 00:00:00+00:00")).alias("day"),
            key("S", "origin"),
            key("C", "destination"),
        )
        .write.option("header", True)
        .option("compression", "gzip")
        # Packing harder takes longer than the join; the files are read once.
        .option("zlib.compress.level", "BEST_SPEED")
        .csv(f"{inputs.flows}/flightlist_19950101_20011231.csv.gz")
    )
    write_csv(
        union_by_name(
            [
                supplier_facilities(spark, sf_dir, defects).select(key("S", "icao"), "country"),
                supplier_facilities(spark, sf_dir, defects).filter("icao % 3 = 0").select(key("S", "icao"), "country"),
                customer_facilities(spark, sf_dir).filter("icao % 10 > 0" if defects else "true").select(key("C", "icao"), "country"),
            ]
        ),
        inputs.facilities,
    )
    write_csv(
        codes(spark, sf_dir).withColumnsRenamed(
            {"country": schemas.CODE_NAME_COLUMN, "country_code": schemas.CODE_COLUMN}
        ),
        inputs.codes,
    )
    return inputs


FILE_SPEC = schemas.SnapshotSpec(first_year=RETAIL.first_year, last_year=RETAIL.last_year)


def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, flows and quality lines of a run over all periods."""
    paths = run_batch(
        spark, batch_files(spark, sf_dir, defects=True), stage_path(spark, "batch-out"), spec=FILE_SPEC
    )
    columns = {
        "cases": "year_month STRING, Country_Region STRING, "
        + ", ".join(f"{m} LONG" for m in RETAIL.month_stats),
        "flows": schemas.FLOW_COUNTS,
        "quality": "section STRING, metric STRING, value DOUBLE",
    }
    read = {
        name: read_partitioned(
            spark, paths[name], spark.createDataFrame([], ddl).schema, RESULT_PARTITIONS
        ).filter((F.col("areas") == "all") & (F.col("batch") == "all"))
        for name, ddl in columns.items()
    }

    def lines(name: str, month: str, label: str, value: str) -> DataFrame:
        return read[name].select(
            F.lit(name).alias("dataset"),
            F.col(month).alias("part"),
            F.col(label).alias("label"),
            F.round(F.col(value).cast("double"), 6).alias("value"),
        )

    pair = F.concat_ws(
        " to ",
        F.concat_ws(" ", "origin_country_code", "origin_country"),
        F.concat_ws(" ", "destination_country_code", "destination_country"),
    )
    read["flows"] = read["flows"].withColumn("pair", pair)
    return union_by_name(
        [
            *[
                lines("cases", "year_month", "Country_Region", m).withColumn("dataset", F.lit(m))
                for m in RETAIL.month_stats
            ],
            lines("flows", "year_month", "pair", "flight_count"),
            lines("quality", "section", "metric", "value"),
        ]
    )


def run_and_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with flows of one area, from the datasets of a run."""
    out = stage_path(spark, "marts-out")
    run_batch(spark, batch_files(spark, sf_dir), out, areas=[FOCUS], spec=FILE_SPEC)
    return marts_from_results(spark, out, FOCUS, FILE_SPEC)["focus_with_flows"]


def csv_marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both batches of both families as CSV files, each family read in one go."""
    root = stage_path(spark, "monthly-csv")
    for name, rows in {"cases": case_rows, "flows": flow_rows}.items():
        (
            rows(spark, sf_dir)
            .write.partitionBy("batch")
            .option("header", True)
            .csv(f"{root}/{name}")
        )
    cases_glob, flows_glob = f"{root}/cases/batch=*", f"{root}/flows/batch=*"
    return marts_from_csv(spark, cases_glob, cases_glob, flows_glob, FOCUS)


def overlapping_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year, and each September, as batches of their own: those months count once."""
    out = stage_path(spark, "overlap-out")
    months = area_month_table(reports(spark, sf_dir), RETAIL).withColumnRenamed("area", "Country_Region")
    counts = count_flows(map_flows(flows(spark, sf_dir), *places(spark, sf_dir)), "destination", "year_month")
    counts = counts.withColumns({c: F.col(c).cast("string") for c in ("origin_country_code", "destination_country_code")})
    months, counts = staged(months, "months"), staged(counts, "counts")
    years = range(RETAIL.first_year - 1, RETAIL.last_year + 2)
    for batch, stem in [(str(y), f"{y}-") for y in years] + [(f"{y}09", f"{y}-09") for y in years]:
        part = months.filter(F.col("year_month").startswith(stem))
        write_batch(part, f"{out}/cases", batch=batch)
        write_batch(part.filter(F.col("Country_Region") == FOCUS), f"{out}/cases", batch=batch, areas=FOCUS)
        write_batch(counts.filter(F.col("year_month").startswith(stem)), f"{out}/flows", batch=batch, areas=FOCUS)
    return marts_from_results(spark, out, FOCUS, FILE_SPEC)["focus_with_flows"]


def aliased_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation renamed by an alias table that comes as a CSV file."""
    path = stage_path(spark, "aliases")
    nations = codes(spark, sf_dir)
    write_csv(
        nations.filter("country_code % 2 = 0").select(
            F.col("country").alias("name"), F.concat(F.lit("Land of "), "country").alias("known")
        ),
        path,
    )
    named_customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("country_code"))
    renamed = with_known_names(named_customers, "country", alias_table(spark, path), "known_as")
    return renamed.select("c_custkey", F.col("known_as").alias("country"))


def aliased_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All countries with their flows, whose names another system gives; a CSV file tells which is which."""
    path = stage_path(spark, "aliases")
    nations = codes(spark, sf_dir).filter("country_code % 2 = 0")
    known = F.concat(F.lit("Land of "), "country").alias("known")
    write_csv(nations.select(F.col("country").alias("name"), known), path)
    table_of = alias_table(spark, path)
    arrivals = with_known_names(ends(spark, sf_dir), "end_country", table_of, "other")
    renamed = arrivals.drop("end_country").withColumnRenamed("other", "end_country")
    return cases_with_flows(cases(spark, sf_dir), renamed, aliases=table_of)


def aliased_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marts of one area, all handed the alias table."""
    table_of = spark.createDataFrame([(FOCUS, "Other Name"), ("x", "y")], "area string, known_as string")
    rows = flow_rows(spark, sf_dir)
    renamed = with_known_names(rows, "destination_country", table_of, "other").drop("destination_country")
    every = case_rows(spark, sf_dir)
    tables = marts(every, every, renamed.withColumnRenamed("other", "destination_country"), FOCUS, RETAIL, aliases=table_of)
    return tables["focus_with_flows"]


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow counts of every level, by month and over all months."""
    return flow_hierarchy(pairs(spark, sf_dir))


def streamed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with flows from two streams of files, one file of each to a micro-batch."""
    root = stage_path(spark, "join-files")
    streams = {}
    for name, rows in {"cases": staged(cases(spark, sf_dir), "cases"), "flows": staged(ends(spark, sf_dir), "flows")}.items():
        for first, last in (("1995", "1996"), ("1997", "1998"), ("1999", "2001"), ("2999", "2999")):
            # The last file holds a month that lets the watermark pass all others.
            later = rows.limit(1).withColumn("month", F.lit("2999-12"))
            part = later if first == "2999" else rows.filter(F.substring("month", 1, 4).between(first, last))
            part.repartition(1).write.mode("append").parquet(f"{root}/{name}")
        streams[name] = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}")
    joined_rows = streamed_cases_with_flows(streams["cases"], streams["flows"])
    append_rows(joined_rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(joined_rows.schema).parquet(f"{root}/out").filter("month < '2999'")


def csv_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_marts(spark, sf_dir)["focus_with_flows"]


def csv_cases_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_marts(spark, sf_dir)["cases_long"]


QUERIES = {
    "batch_union_recombine": recombined_cases,
    "batch_union_recombine_max": recombined_cases_max,
    "month_over_month": cases,
    "flow_recombine": recombined_flows,
    "flow_recombine_one_pass": pairs,
    "flow_destination_rollup": ends,
    "stats_flow_join": joined,
    "stats_flow_join_one_area": joined_focus,
    "unpivot_stats": long_cases,
    "stat_rows_labelled": labelled_stat,
    "unpivot_wide_dates": long_orders,
    "wide_series_marts": wide_marts,
    "wide_series_maps": wide_maps,
    "month_grouper_sum": month_sums,
    "month_grouper_max": month_peaks,
    "time_series_range": series_in_range,
    "map_flows_range": flows_in_range,
    "map_peak_range": peaks_in_range,
    "map_scale_bounds": scales,
    "stat_flow_corr": focus_correlation,
    "stat_flow_corr_by_area": area_correlation,
    "month_domain": months,
    "default_range": ranges,
    "label_sanitise": labels,
    "csv_marts_focus": csv_focus,
    "csv_marts_cases_long": csv_cases_long,
    "all_period_job": whole_run,
    "dashboard_marts": run_and_marts,
    "marts_overlapping_batches": overlapping_marts,
    "alias_table_lookup": aliased_lookup,
    "marts_aliased_countries": aliased_marts,
    "marts_aliased_focus": aliased_focus,
    "flow_hierarchy": hierarchy,
    "stream_stats_flow_join": streamed_join,
}

MERGED = """
    SELECT year_month, area,
           CAST(coalesce({f}(c), 0) AS BIGINT) AS "Confirmed_cumulative",
           CAST(coalesce({f}(d), 0) AS BIGINT) AS "Deaths_cumulative",
           CAST(coalesce({f}(r), 0) AS BIGINT) AS "Recovered_cumulative",
           CAST(coalesce({f}(a), 0) AS BIGINT) AS "Active_cumulative"
    FROM batch_rows GROUP BY 1, 2"""
ARRIVALS = """(
    SELECT year_month AS month, destination_country AS end_country,
           CAST(sum(flight_count) AS BIGINT) AS flight_count
    FROM flow_counts GROUP BY 1, 2) AS arrivals"""
JOINED = f"""(
    SELECT cases.*, flight_count FROM cases LEFT JOIN {ARRIVALS}
    ON cases.month = arrivals.month AND country = end_country) AS joined"""
RANGE = f"month BETWEEN '{START}' AND '{END}'"

# The whole run takes the cases as one batch.
ONE_BATCH = """(
    SELECT *,
           "Confirmed_cumulative" - lag("Confirmed_cumulative") OVER w AS "Confirmed_monthly_new",
           "Deaths_cumulative" - lag("Deaths_cumulative") OVER w AS "Deaths_monthly_new",
           "Recovered_cumulative" - lag("Recovered_cumulative") OVER w AS "Recovered_monthly_new",
           "Active_cumulative" - lag("Active_cumulative") OVER w AS "Active_monthly_new"
    FROM (
        SELECT year_month AS month, area AS country,
               coalesce("Confirmed_cumulative", 0) AS "Confirmed_cumulative",
               coalesce("Deaths_cumulative", 0) AS "Deaths_cumulative",
               coalesce("Recovered_cumulative", 0) AS "Recovered_cumulative",
               coalesce("Active_cumulative", 0) AS "Active_cumulative"
        FROM months) AS m
    WINDOW w AS (PARTITION BY country ORDER BY month)) AS one_batch"""


FOREIGN_NAME = f"'{FOREIGN['NATION_7']}'"
FLOW_COLUMNS = (
    "day", "year_month", "origin_icao", "origin_country_code", "origin_country",
    "destination_icao", "destination_country_code", "destination_country",
)
# Flows of the run, without the facilities that its file leaves out.
RUN_FLOWS = f"""(
    SELECT * REPLACE ({", ".join(f"CASE WHEN destination_icao % 10 > 0 THEN {c} END AS {c}" for c in FLOW_COLUMNS[5:])})
    FROM gap_mapped) AS run_flows"""


def with_foreign_name(statement: str) -> str:
    """The statement over reports in which one nation has another name."""
    plain, place = "SELECT n_name AS area, c_mktsegment AS segment", "CASE n_name WHEN 'NATION_7' THEN {} ELSE n_name END"
    if statement.count(plain) != 1:
        raise ValueError("the reports are not where they were")
    return statement.replace(plain, plain.replace("n_name", place.format(FOREIGN_NAME)))


RUN_QUALITY = [
    line
    for line in QUALITY_LINES
    if line.startswith(("SELECT 'reports'", "SELECT 'area_day_nulls'"))
]

SQL = {
    "batch_union_recombine": sql(MERGED.format(f="sum")),
    "batch_union_recombine_max": sql(MERGED.format(f="max")),
    "month_over_month": sql("SELECT * FROM cases"),
    "flow_recombine": sql(
        """SELECT year_month AS month, destination_country AS end_country,
        destination_country_code, origin_country, origin_country_code, flight_count
        FROM flow_counts"""
    ),
    "flow_recombine_one_pass": sql(
        """SELECT year_month AS month, destination_country AS end_country,
        destination_country_code, origin_country, origin_country_code, flight_count
        FROM flow_counts"""
    ),
    "flow_destination_rollup": sql(f"SELECT * FROM {ARRIVALS}"),
    "stats_flow_join": sql(f"SELECT * FROM {JOINED}"),
    "stats_flow_join_one_area": sql(f"SELECT * FROM {JOINED} WHERE country = '{FOCUS}'"),
    "unpivot_stats": sql("SELECT * FROM cases_long"),
    "stat_rows_labelled": sql(
        """SELECT *, 'Deaths Monthly New' AS label FROM cases_long
        WHERE stat = 'Deaths_monthly_new'"""
    ),
    "unpivot_wide_dates": sql(
        """SELECT a.area, strftime(m.day, '%Y-%m-%d') AS day, CAST(sum(price) AS BIGINT) AS price
        FROM (SELECT DISTINCT area FROM orders_by_nation) AS a
        CROSS JOIN (SELECT CAST(unnest(generate_series(
            (SELECT date_trunc('month', min(o_orderdate)) FROM orders),
            (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS day) AS m
        LEFT JOIN orders_by_nation AS o
            ON o.area = a.area AND date_trunc('month', o.day) = m.day
        GROUP BY 1, 2"""
    ),
    "wide_series_marts": sql(
        f"""SELECT c.*, flight_count AS flights FROM (
            SELECT a.area AS country, strftime(m.day, '%Y-%m') AS month,
                   CAST(sum(price) AS BIGINT) AS cases
            FROM (SELECT DISTINCT area FROM orders_by_nation WHERE area = '{FOCUS}') AS a
            CROSS JOIN (SELECT CAST(unnest(generate_series(
                (SELECT date_trunc('month', min(o_orderdate)) FROM orders),
            (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS DATE) AS day) AS m
            LEFT JOIN orders_by_nation AS o
                ON o.area = a.area AND date_trunc('month', o.day) = m.day
            GROUP BY 1, 2) AS c
        LEFT JOIN {ARRIVALS} ON c.month = arrivals.month AND country = end_country"""
    ),
    "wide_series_maps": sql(
        f"""SELECT 'flows' AS map, destination_country AS country, CAST(sum(flight_count) AS BIGINT) AS value
        FROM flow_counts WHERE year_month BETWEEN '{START}' AND '{END}' GROUP BY 1, 2
        UNION ALL
        SELECT 'peaks', area, max(price) FROM (
            SELECT area, strftime(day, '%Y-%m') AS month, CAST(sum(price) AS BIGINT) AS price
            FROM orders_by_nation GROUP BY 1, 2) AS m
        WHERE {RANGE} GROUP BY 1, 2"""
    ),
    "month_grouper_sum": sql(
        """SELECT area, strftime(day, '%Y-%m') AS month, CAST(sum(price) AS BIGINT) AS price
        FROM orders_by_nation GROUP BY 1, 2"""
    ),
    "month_grouper_max": sql(
        """SELECT area, strftime(day, '%Y-%m') AS month, CAST(max(price) AS BIGINT) AS price
        FROM (SELECT area, day, sum(price) AS price FROM orders_by_nation GROUP BY 1, 2) AS d
        GROUP BY 1, 2"""
    ),
    "time_series_range": sql(
        f"""SELECT month, 'Deaths Cumulative' AS label, "Deaths_cumulative" AS value, flight_count
        FROM {JOINED} WHERE country = '{FOCUS}' AND {RANGE}"""
    ),
    "map_flows_range": sql(
        f"""SELECT origin_country, CAST(sum(flight_count) AS BIGINT) AS flight_count
        FROM flow_counts WHERE year_month BETWEEN '{START}' AND '{END}' GROUP BY 1"""
    ),
    "map_peak_range": sql(
        f"""SELECT country, max(value) AS value FROM cases_long
        WHERE stat = 'Confirmed_monthly_new' AND {RANGE} GROUP BY 1"""
    ),
    "map_scale_bounds": sql(
        """SELECT (SELECT CAST(max(n) AS BIGINT) FROM (
            SELECT sum(flight_count) AS n FROM flow_counts GROUP BY origin_country) AS t
        ) AS max_flights, (SELECT max("Confirmed_monthly_new") FROM cases) AS max_cases"""
    ),
    "stat_flow_corr": sql(
        f"""SELECT round(r, 6) AS r, round(r, 2) AS shown FROM (
            SELECT corr("Confirmed_cumulative", flight_count) AS r FROM {JOINED}
            WHERE country = '{FOCUS}' AND {RANGE}) AS c"""
    ),
    "stat_flow_corr_by_area": sql(
        f"""SELECT country, round(corr("Confirmed_monthly_new", flight_count), 6) AS r
        FROM {JOINED} GROUP BY 1"""
    ),
    "month_domain": sql("SELECT DISTINCT year_month AS month FROM flow_counts"),
    "default_range": sql(
        """SELECT min(year_month) AS range_start, '1998-08' AS range_end, '1998-08' AS cut
        FROM flow_counts
        UNION ALL SELECT min(year_month), max(year_month), '2020-08' FROM flow_counts"""
    ),
    "label_sanitise": """
        SELECT p_partkey,
               upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' '
               || upper(split_part(p_name, ' ', 2)[1])
               || substr(split_part(p_name, ' ', 2), 2) || ' Cumulative' AS label,
               replace(p_name, ' ', '_') || '_monthly_new' AS monthly,
               replace(p_name, ' ', '_') || '__' || p_type || '__all' AS slug,
               substr(p_brand, 7, 2) AS brand_number, 1 AS is_number
        FROM part""",
    "csv_marts_focus": sql(f"SELECT * FROM {JOINED} WHERE country = '{FOCUS}'"),
    "csv_marts_cases_long": sql("SELECT * FROM cases_long"),
    "all_period_job": with_foreign_name(sql(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS dataset, year_month AS part, area AS label,
               CAST("{m}" AS DOUBLE) AS value FROM months
        """
            for m in RETAIL.month_stats
        )
        + f"""UNION ALL
        SELECT 'flows', year_month, origin_country_code || ' ' || origin_country || ' to '
               || destination_country_code || ' ' || destination_country,
               CAST(count(*) AS DOUBLE) FROM {RUN_FLOWS}
        WHERE day IS NOT NULL AND origin_country IS NOT NULL AND destination_country IS NOT NULL
          AND origin_country_code <> destination_country_code GROUP BY ALL
        UNION ALL
        SELECT 'quality', section,
               CASE metric WHEN 'area' THEN 'Country_Region' ELSE metric END, value FROM ("""
        + " UNION ALL ".join(RUN_QUALITY)
        + f"""
            UNION ALL SELECT * FROM (
                SELECT 'abnormal_day', strftime(day, '%Y-%m-%d') || ' ' || area, CAST(report_rows AS DOUBLE)
                FROM totals WHERE year(day) NOT BETWEEN 1996 AND 2000 ORDER BY day, area LIMIT 10)
            UNION ALL SELECT 'scan', 'rejected_rows', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderkey % 7 = 0
            UNION ALL SELECT 'facilities', 'repeated_facilities', CAST(count(*) AS DOUBLE) FROM supplier WHERE s_suppkey % 3 = 0
            UNION ALL SELECT 'names', 'unmatched_names', 1.0
            UNION ALL SELECT 'unmatched_name', {FOREIGN_NAME}, 1.0
            UNION ALL SELECT * FROM (
                SELECT 'name_candidate', {FOREIGN_NAME} || ' is ' || n_name, round(1 - levenshtein('77 nation', plain) / greatest(9, length(plain)), 6)
                FROM (SELECT n_name, {PLAIN.format(x="n_name")} AS plain FROM nation) AS n
                WHERE levenshtein('77 nation', plain) <= greatest(greatest(9, length(plain)) // 4, 2)
                ORDER BY 3 DESC, n_name LIMIT 1)
            UNION ALL SELECT 'flow_nulls', metric, CAST(value AS DOUBLE) FROM (
                UNPIVOT (SELECT {", ".join(f"{missing(c)} AS {c}" for c in FLOW_COLUMNS)} FROM {RUN_FLOWS})
                ON COLUMNS(*) INTO NAME metric VALUE value)) AS q"""
    )),
    "marts_overlapping_batches": sql(
        f"""SELECT one_batch.*, flight_count FROM {ONE_BATCH} LEFT JOIN {ARRIVALS}
        ON one_batch.month = arrivals.month AND country = end_country
        WHERE country = '{FOCUS}'"""
    ),
    "alias_table_lookup": """
        SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Land of ' || n_name ELSE n_name END AS country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "marts_aliased_countries": sql(f"SELECT * FROM {JOINED}"),
    "marts_aliased_focus": sql(f"SELECT * FROM {JOINED} WHERE country = '{FOCUS}'"),
    "stream_stats_flow_join": sql(f"SELECT * FROM {JOINED}"),
    "flow_hierarchy": sql("""
        SELECT CASE WHEN grouping(origin_country) = 0 AND grouping(destination_country) = 0 THEN 'pair'
                    WHEN grouping(destination_country) = 0 THEN 'destination'
                    WHEN grouping(origin_country) = 0 THEN 'origin' ELSE 'all' END AS level,
               CASE WHEN grouping(year_month) = 0 THEN 'month' ELSE 'all' END AS period,
               year_month AS month, origin_country, origin_country_code, destination_country AS end_country,
               destination_country_code, CAST(sum(flight_count) AS BIGINT) AS flight_count
        FROM flow_counts GROUP BY GROUPING SETS (
            (year_month, origin_country, origin_country_code, destination_country, destination_country_code),
            (origin_country, origin_country_code, destination_country, destination_country_code),
            (year_month, destination_country, destination_country_code), (destination_country, destination_country_code),
            (year_month, origin_country, origin_country_code), (origin_country, origin_country_code), (year_month), ())"""),
    "dashboard_marts": sql(
        f"""SELECT one_batch.*, flight_count FROM {ONE_BATCH} LEFT JOIN {ARRIVALS}
        ON one_batch.month = arrivals.month AND country = end_country
        WHERE country = '{FOCUS}'"""
    ),
}
