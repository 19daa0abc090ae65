"""Snapshot tables and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.checks.tables import (
    RETAIL,
    codes,
    customer_facilities,
    dated_orders,
    flows,
    places,
    reports,
    sql,
    supplier_facilities,
    table,
)
from tallyflow.functions.calendar import day_text
from tallyflow.functions.columns import named
from tallyflow.operators.filters import (
    abnormal_days,
    among,
    plausible_areas,
    renamed_areas,
    valid_days,
)
from tallyflow.operators.lookups import repeated_keys, unmatched
from tallyflow.operators.matching import name_candidates
from tallyflow.operators.quality import abnormal_sample, day_audit, null_profile
from tallyflow.operators.reshape import union_by_name
from tallyflow.operators.rollups import area_day_totals
from tallyflow.plans.flows import map_flows
from tallyflow.plans.quality_report import flow_report, snapshot_report, unmatched_names
from tallyflow.plans.snapshots import area_day_table, area_month_table
from tallyflow.session import stage_path, staged
from tallyflow.streaming.running_counts import daily_counts, keep_updated, latest_counts
from tallyflow.streaming.running_days import keep_days_updated, latest_days, running_totals

NATIONS = ["NATION_1", "NATION_5", "NATION_24"]
ALIASES = {"NATION_1": "First Nation", "NATION_24": "Last Nation"}


def shown_stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("stamp", day_text(F.col("stamp")))


def customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    known = codes(spark, sf_dir)
    return customer.join(known, customer.c_nationkey == known.country_code).select(
        "c_custkey", "country", "c_mktsegment"
    )


def chosen_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return among(customers_by_nation(spark, sf_dir), "country", NATIONS)


def aliased_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_by_nation(spark, sf_dir).select(
        "c_custkey", renamed_areas(F.col("country"), ALIASES).alias("country")
    )


def unknown_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the renamed system that the plain one does not know."""
    return unmatched(
        aliased_countries(spark, sf_dir), "country", codes(spark, sf_dir), "country"
    )


def abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_stamp(abnormal_days(dated_orders(spark, sf_dir), "stamp", RETAIL))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_stamp(valid_days(dated_orders(spark, sf_dir), "stamp", RETAIL))


def named_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = plausible_areas(dated_orders(spark, sf_dir), "area")
    return kept.select("o_orderkey", "area")


def abnormal_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_stamp(
        abnormal_sample(dated_orders(spark, sf_dir), "stamp", RETAIL, ["o_orderkey"], 10)
    )


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_profile(dated_orders(spark, sf_dir))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = day_audit(dated_orders(spark, sf_dir), "stamp", RETAIL)
    return counts.withColumn("abnormal_days_pct", F.round("abnormal_days_pct", 6))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the report, for the reports and for flows with gaps."""
    totals = staged(area_day_totals(reports(spark, sf_dir), RETAIL), "totals")
    facilities = union_by_name(
        [supplier_facilities(spark, sf_dir), customer_facilities(spark, sf_dir)]
    )
    mapped = map_flows(
        flows(spark, sf_dir, gaps=True),
        *places(spark, sf_dir, gaps=True),
        keep_incomplete=True,
    )
    lines = union_by_name(
        [
            snapshot_report(totals, RETAIL),
            flow_report(mapped, facilities),
            unmatched_names(
                aliased_countries(spark, sf_dir), "country", codes(spark, sf_dir), "country"
            ),
        ]
    )
    return lines.withColumn("value", F.round("value", 6))


def repeated_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that suppliers and customers share, with their number of rows."""
    both = union_by_name(
        [supplier_facilities(spark, sf_dir), customer_facilities(spark, sf_dir)]
    )
    return repeated_keys(both, "icao")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = area_day_table(reports(spark, sf_dir), RETAIL)
    return days.withColumn("date", day_text(F.col("date")))


def daily_of_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = area_day_table(reports(spark, sf_dir), RETAIL, NATIONS)
    return days.withColumn("date", day_text(F.col("date")))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_month_table(reports(spark, sf_dir), RETAIL)


def monthly_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = area_month_table(reports(spark, sf_dir), RETAIL, closing="last")
    return months.select("year_month", "area", *[named(c) for c in RETAIL.cumulative])


def day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up before any filter, with the number of rows in each sum."""
    totals = area_day_totals(reports(spark, sf_dir), RETAIL)
    return totals.withColumn("date", day_text(F.col("date")))


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, counted from a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    out = stage_path(spark, "stream-counts")
    keys = ["day", "event_type"]
    counts = daily_counts(stream, "ts", ["event_type"])
    keep_updated(counts, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    latest = latest_counts(spark, f"{out}/rows", keys)
    return latest.withColumn("day", day_text(F.col("day")))


def streamed_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from four files, one to a micro-batch, and every second micro-batch compacts."""
    events = table(spark, sf_dir, "events")
    folder, out = stage_path(spark, "event-files"), stage_path(spark, "stream-counts")
    events.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    keys = ["day", "event_type"]
    counts = daily_counts(stream, "ts", ["event_type"])
    keep_updated(counts, f"{out}/rows", f"{out}/checkpoint", keys, compact_every=2).awaitTermination()
    return latest_counts(spark, f"{out}/rows", keys).withColumn("day", day_text(F.col("day")))


def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country-day table from reports that come in no order, file by file."""
    folder, out = stage_path(spark, "report-files"), stage_path(spark, "stream-days")
    rows = reports(spark, sf_dir)
    rows.repartition(5).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    totals = running_totals(stream, RETAIL)
    keep_days_updated(totals, f"{out}/rows", f"{out}/checkpoint", RETAIL, compact_every=3).awaitTermination()
    return latest_days(spark, f"{out}/rows", RETAIL).withColumn("date", day_text(F.col("date")))


def misspelt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names and types of all parts, and the same with a letter left out, doubled, or words exchanged."""
    part = table(spark, sf_dir, "part")
    known = part.select(F.concat_ws(" ", "p_name", "p_type").alias("known")).distinct()
    name, at = F.col("known"), F.ascii(F.substring("known", 3, 1)) % (F.length("known") - 4) + 2
    rest = F.substr(name, at + 1, F.length(name))
    words = F.split(name, " ")
    typos = F.array(
        F.concat(F.substr(name, F.lit(1), at - 1), rest),
        F.concat(F.substr(name, F.lit(1), at), F.substr(name, at, F.lit(1)), rest),
        F.concat_ws(", ", F.element_at(words, -1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")),
    )
    return known, known.select(F.explode(typos).alias("name"), "known").filter("name <> known").distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest known name of each misspelt one."""
    known, wrong = misspelt(spark, sf_dir)
    found = name_candidates(wrong, "name", known, "known")
    return found.select("name", "candidate", F.round("score", 6).alias("score"))


QUERIES = {
    "country_in_filter": chosen_countries,
    "alias_mapping": aliased_countries,
    "unmatched_names": unknown_countries,
    "abnormal_dates": abnormal,
    "valid_dates": valid,
    "plausible_area_names": named_areas,
    "abnormal_sample": abnormal_first,
    "null_profile": nulls,
    "abnormal_share": audit,
    "quality_report": quality,
    "repeated_facilities": repeated_facilities,
    "area_day_totals": day_rollup,
    "snapshot_daily": daily,
    "snapshot_daily_of_countries": daily_of_some,
    "snapshot_monthly": monthly,
    "snapshot_monthly_last": monthly_last,
    "stream_daily_counts": streamed_counts,
    "stream_daily_counts_compacted": streamed_compacted,
    "stream_day_changes": streamed_days,
    "name_candidates": candidates,
}

PLAIN = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ')"
ABNORMAL = "stamp IS NULL OR year(stamp) NOT BETWEEN 1996 AND 2000"
STAMPED = "o_orderkey, strftime(stamp, '%Y-%m-%d') AS stamp, area, price"
DAILY = """
    SELECT strftime(day, '%Y-%m-%d') AS date, area,
           confirmed AS "Confirmed_cumulative", deaths AS "Deaths_cumulative",
           recovered AS "Recovered_cumulative", active AS "Active_cumulative",
           new_confirmed AS "Confirmed_daily_new", new_deaths AS "Deaths_daily_new",
           new_recovered AS "Recovered_daily_new", new_active AS "Active_daily_new"
    FROM days"""
IN_NATIONS = ", ".join(f"'{n}'" for n in NATIONS)
CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"
ALIASED = """CASE n_name WHEN 'NATION_1' THEN 'First Nation' WHEN 'NATION_24' THEN 'Last Nation'
             ELSE n_name END"""


def report_line(section: str, metric: str, value: str, source: str) -> str:
    return (
        f"SELECT '{section}' AS section, '{metric}' AS metric, "
        f"CAST({value} AS DOUBLE) AS value FROM {source}"
    )


def missing(column: str) -> str:
    return f"count(*) FILTER (WHERE {column} IS NULL)"


QUALITY_LINES = [
    report_line("scan", "rejected_rows", "count(*) FILTER (WHERE area IS NULL)", "reports"),
    report_line("reports", "rows", "count(*)", "reports"),
    report_line("reports", "abnormal_days", f"count(*) FILTER (WHERE {ABNORMAL})", "reports"),
    report_line(
        "reports",
        "abnormal_days_pct",
        f"round(100.0 * count(*) FILTER (WHERE {ABNORMAL}) / count(*), 6)",
        "reports",
    ),
    report_line(
        "reports",
        "numbered_areas",
        "count(*) FILTER (WHERE regexp_full_match(area, '[0-9]+'))",
        "reports",
    ),
    *[
        report_line("area_day_nulls", metric, missing(column), "days")
        for metric, column in {
            "date": "day",
            "area": "area",
            "Confirmed_cumulative": "confirmed",
            "Deaths_cumulative": "deaths",
            "Recovered_cumulative": "recovered",
            "Active_cumulative": "active",
            "Confirmed_daily_new": "new_confirmed",
            "Deaths_daily_new": "new_deaths",
            "Recovered_daily_new": "new_recovered",
            "Active_daily_new": "new_active",
        }.items()
    ],
    *[
        report_line("flow_nulls", c, missing(c), "gap_mapped")
        for c in (
            "day",
            "year_month",
            "origin_icao",
            "origin_country_code",
            "origin_country",
            "destination_icao",
            "destination_country_code",
            "destination_country",
        )
    ],
    report_line(
        "facilities",
        "repeated_facilities",
        "count(*)",
        "supplier JOIN customer ON s_suppkey = c_custkey",
    ),
    report_line(
        "names",
        "unmatched_names",
        f"count(DISTINCT n_name) FILTER (WHERE {ALIASED} <> n_name)",
        CUSTOMERS,
    ),
    f"""SELECT DISTINCT 'unmatched_name' AS section, {ALIASED} AS metric, 1.0::DOUBLE AS value
    FROM {CUSTOMERS} WHERE {ALIASED} <> n_name""",
    f"""SELECT 'name_candidate' AS section, name || ' is ' || n_name AS metric, round(1 - edits / longer, 6) AS value FROM (
        SELECT name, n_name, levenshtein(a, b) AS edits, greatest(length(a), length(b)) AS longer FROM (
            SELECT DISTINCT {ALIASED} AS name, {PLAIN.format(x=ALIASED)} AS a FROM {CUSTOMERS} WHERE {ALIASED} <> n_name) AS u
        CROSS JOIN (SELECT n_name, {PLAIN.format(x='n_name')} AS b FROM nation) AS k) AS p
    WHERE edits < longer AND edits <= greatest(longer // 4, least(longer // 2, 2), 1)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY 1 - edits / longer DESC, n_name) = 1""",
    """SELECT * FROM (
        SELECT 'abnormal_day' AS section, strftime(day, '%Y-%m-%d') || ' ' || area AS metric,
               CAST(report_rows AS DOUBLE) AS value
        FROM totals WHERE year(day) NOT BETWEEN 1996 AND 2000 ORDER BY day, area LIMIT 10) AS a""",
]

EVENT_COUNTS = """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n
        FROM events GROUP BY 1, 2"""

SQL = {
    "country_in_filter": f"""
        SELECT c_custkey, n_name AS country, c_mktsegment FROM {CUSTOMERS}
        WHERE n_name IN ({IN_NATIONS})""",
    "alias_mapping": f"SELECT c_custkey, {ALIASED} AS country FROM {CUSTOMERS}",
    "unmatched_names": f"""
        SELECT DISTINCT {ALIASED} AS country FROM {CUSTOMERS}
        WHERE {ALIASED} NOT IN (SELECT n_name FROM nation)""",
    "abnormal_dates": sql(f"SELECT {STAMPED} FROM dated_orders WHERE {ABNORMAL}"),
    "valid_dates": sql(f"SELECT {STAMPED} FROM dated_orders WHERE NOT ({ABNORMAL})"),
    "plausible_area_names": sql(
        """SELECT o_orderkey, area FROM dated_orders
        WHERE NOT regexp_full_match(area, '[0-9]+')"""
    ),
    "abnormal_sample": sql(
        f"SELECT {STAMPED} FROM dated_orders WHERE {ABNORMAL} ORDER BY o_orderkey LIMIT 10"
    ),
    "null_profile": sql(
        f"""SELECT {missing('o_orderkey')} AS o_orderkey, {missing('stamp')} AS stamp,
        {missing('area')} AS area, {missing('price')} AS price FROM dated_orders"""
    ),
    "abnormal_share": sql(
        f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {ABNORMAL}) AS abnormal_days,
        round(100.0 * count(*) FILTER (WHERE {ABNORMAL}) / count(*), 6) AS abnormal_days_pct,
        count(*) FILTER (WHERE regexp_full_match(area, '[0-9]+')) AS numbered_areas
        FROM dated_orders"""
    ),
    "quality_report": sql(" UNION ALL ".join(QUALITY_LINES)),
    "repeated_facilities": """
        SELECT icao, count(*) AS rows FROM (
            SELECT s_suppkey AS icao FROM supplier UNION ALL SELECT c_custkey FROM customer
        ) AS f GROUP BY 1 HAVING count(*) > 1""",
    "area_day_totals": sql(
        """SELECT strftime(day, '%Y-%m-%d') AS date, area, confirmed AS "Confirmed",
        deaths AS "Deaths", recovered AS "Recovered", active AS "Active", report_rows,
        CAST(0 AS BIGINT) AS rejected_rows
        FROM totals"""
    ),
    "snapshot_daily": sql(DAILY),
    "snapshot_daily_of_countries": sql(f"{DAILY} WHERE area IN ({IN_NATIONS})"),
    "snapshot_monthly": sql("SELECT * FROM months"),
    "snapshot_monthly_last": sql(
        """SELECT strftime(day, '%Y-%m') AS year_month, area,
        arg_max_null(confirmed, day) AS "Confirmed_cumulative",
        arg_max_null(deaths, day) AS "Deaths_cumulative",
        arg_max_null(recovered, day) AS "Recovered_cumulative",
        arg_max_null(active, day) AS "Active_cumulative"
        FROM days GROUP BY 1, 2"""
    ),
    "stream_daily_counts": EVENT_COUNTS,
    "stream_daily_counts_compacted": EVENT_COUNTS,
    "stream_day_changes": sql(DAILY),
    "name_candidates": f"""
        WITH known AS (SELECT DISTINCT p_name || ' ' || p_type AS known FROM part),
        typos AS (SELECT known, ascii(known[3]) % (length(known) - 4) + 2 AS pos FROM known),
        wrong AS (
            SELECT DISTINCT name FROM (SELECT known, unnest([
                substr(known, 1, pos - 1) || substr(known, pos + 1), substr(known, 1, pos) || known[pos] || substr(known, pos + 1),
                split_part(known, ' ', -1) || ', ' || substr(known, 1, length(known) - length(split_part(known, ' ', -1)) - 1)]) AS name
            FROM typos) AS t WHERE name <> known),
        pairs AS (
            SELECT name, known AS candidate, levenshtein(a, b) AS edits, greatest(length(a), length(b)) AS longer
            FROM (SELECT name, {PLAIN.format(x='name')} AS a FROM wrong) AS w
            CROSS JOIN (SELECT known, {PLAIN.format(x='known')} AS b FROM known) AS k)
        SELECT name, candidate, round(1 - edits / longer, 6) AS score FROM pairs
        WHERE edits < longer AND edits <= greatest(longer // 4, least(longer // 2, 2), 1)
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY 1 - edits / longer DESC, candidate) = 1""",
}
