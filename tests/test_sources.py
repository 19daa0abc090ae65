from __future__ import annotations

import datetime as dt
import fnmatch

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow import schemas
from tallyflow.functions.calendar import utc_day
from tallyflow.operators.rollups import area_day_totals
from tallyflow.plans.flows import map_flows
from tallyflow.plans.snapshots import area_day_table
from tallyflow.sources import readers
from tallyflow.sources.batches import flow_glob, period_parts, report_glob
from tallyflow.sources.sinks import RESULT_PARTITIONS, land_by_month, write_batch, write_csv
from tests.conftest import rows

HEADER = (
    "FIPS,Admin2,Province_State,Country_Region,Last_Update,Lat,Long_,Confirmed,Deaths,"
    "Recovered,Active,Combined_Key,Incident_Rate,Case_Fatality_Ratio"
)
OLD_HEADER = "Province/State,Country/Region,Last Update,Confirmed,Deaths,Recovered"


def report(area="US", stamp="2021-01-02 05:22:33", confirmed="10", lat="1.5"):
    return f'1,Adm,Prov,{area},{stamp},{lat},2.5,{confirmed},1,2,7,"Adm, Prov",0.1,0.2'


USED = ["Country_Region", "Last_Update", "Confirmed", "Deaths", "Recovered", "Active"]


def test_other_layout_and_short_rows_are_dropped(spark, write, tmp_path):
    write("01-01-2021.csv", HEADER, report("US"), report("FR"))
    write(
        "01-02-2021.csv",
        OLD_HEADER,
        "Hubei,Mainland China,2020-02-26T14:13:10,65187,2615,20969",
        "X,Y,2020-02-26T14:13:10,300,2021,3",
    )
    write("01-03-2021.csv", HEADER, "1,Adm,Prov,DE,2021-01-02 05:22:33,1,2,3")
    got = readers.read_reports(spark, str(tmp_path), "202101").select(*USED)
    assert rows(got, "Country_Region") == [("FR",), ("US",)]


def test_bad_value_drops_its_row_only_in_a_used_column(spark, write, tmp_path):
    write(
        "01-01-2021.csv",
        HEADER,
        report("A", confirmed="10.0"),
        report("B", lat="xx"),
        report("C"),
    )
    got = readers.read_reports(spark, str(tmp_path), "2021").select(*USED)
    assert [r[0] for r in rows(got)] == ["B", "C"]


def test_rejects_are_counted_in_the_same_scan(spark, write, tmp_path):
    write(
        "01-01-2021.csv", HEADER, report("A", confirmed="10.0"), report("B"), report("B"), "1,2"
    )
    with_rejects = readers.read_reports(spark, str(tmp_path), rejects=True)
    totals = area_day_totals(with_rejects, schemas.SnapshotSpec())
    assert rows(totals, "Country_Region", "Confirmed", "report_rows", "rejected_rows") == [
        ("B", 20, 2, 0),
        (None, None, 0, 2),
    ]
    plain = area_day_table(readers.read_reports(spark, str(tmp_path)))
    assert rows(area_day_table(with_rejects)) == rows(plain)


def test_only_lines_with_enough_commas_are_read_again(spark, write, tmp_path):
    names = [f.name for f in T.StructType.fromDDL(schemas.DAILY_REPORT)]
    twelve = ',,,US,2021-01-02 00:00:00,,,1,2,3,4,"a, b"'
    quoted = '"a,b,c,d,e,f,g,h,i,j,k,l,m",US'
    write("01-02-2021.csv", ",".join(names), twelve + ",,", twelve, twelve + ",", "x,y", quoted, "x", ",,,US,2021-01-02 00:00:00,,,1,2,3,4")
    found = readers.read_reports(spark, str(tmp_path), rejects=True)
    kept = found.filter("_layout > 0").select("_layout", "Combined_Key", "Confirmed")
    assert rows(kept) == [(12, "a, b", 1), (14, "a, b", 1)]
    assert [r["_layout"] for r in found.collect() if r["_rejected_line"] is not None] == [0] * 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN ((length(_rejected_line" in plan


def test_scan_profile_and_kept_rows(spark, write):
    path = write("a.csv", "k,v", "1,x", "2,", "bad,y", "3")
    scanned = readers.read_with_rejects(spark, path, "k LONG, v STRING")
    assert rows(readers.scan_profile(scanned)) == [(2, 2, 2, 1)]
    assert rows(readers.kept_rows(scanned)) == [(1, "x"), (2, None)]


def test_missing_batch_is_an_empty_frame_of_the_same_schema(spark, tmp_path):
    none = readers.read_reports(spark, str(tmp_path), "202101")
    assert none.count() == 0
    assert [f.name for f in none.schema] == HEADER.split(",")
    assert readers.read_reports(spark, str(tmp_path), "2021", rejects=True).count() == 0
    flows = readers.read_flows(spark, str(tmp_path), "202101")
    assert flows.columns == list(schemas.FLOW_COLUMNS) and flows.count() == 0


def test_only_a_missing_path_is_forgiven(spark, write):
    path = write("a.csv", "k", "1")
    with pytest.raises(AnalysisException):
        readers.read_declared(spark, "/nowhere/*.csv", "k LONG")
    with pytest.raises(AnalysisException):
        readers.read_declared(spark, path, "k LONG", missing_ok=True).select("other")


def test_both_file_name_forms_are_read(spark, write, tmp_path):
    write("01-02-2022.csv", HEADER, report("A"))
    write("2022-01-03.csv", HEADER, report("B"))
    write("02-01-2022.csv", HEADER, report("C"))
    write("01-01-2021.csv", HEADER, report("D"))
    write("notes.csv", HEADER, report("E"))
    for period, expected in {"202201": "AB", "2022": "ABC", "*": "ABCD"}.items():
        got = readers.read_reports(spark, str(tmp_path), period)
        assert "".join(r[0] for r in rows(got, "Country_Region")) == expected


@pytest.mark.parametrize("period", ["202", "2021-01", "", "20210101"])
def test_period_is_checked(period):
    with pytest.raises(ValueError):
        period_parts(period)


def test_flow_glob():
    names = [f"flightlist_{m}01_{m}30.csv.gz" for m in ("202012", "202101", "202102")]
    assert fnmatch.filter(names, flow_glob("202101")) == names[1:2]
    assert fnmatch.filter(names, flow_glob("2021")) == names[1:]
    assert fnmatch.filter(names, flow_glob("*")) == names
    assert report_glob("202101", prefix="p/", suffix="").startswith("p/{01-")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_do_not_depend_on_the_session_zone(spark, write, tmp_path, conf, zone):
    write(
        "flightlist_20210101_20210131.csv.gz",
        "callsign,origin,destination,day",
        "X,A,B,2021-01-01 00:00:00+00:00",
    )
    write("01-01-2021.csv", HEADER, report(stamp="2021-01-01 00:30:00"))
    with conf(spark__sql__session__timeZone=zone):
        flows = readers.read_flows(spark, str(tmp_path), "202101")
        places = spark.createDataFrame(
            [("A", "XX", "X land"), ("B", "YY", "Y land")],
            "icao string, country_code string, country string",
        )
        assert rows(map_flows(flows, places), "day", "year_month") == [
            (dt.date(2021, 1, 1), "2021-01")
        ]
        days = area_day_table(readers.read_reports(spark, str(tmp_path)))
        assert rows(days, "date") == [(dt.date(2021, 1, 1),)]


def test_utc_day_of_each_type(spark):
    df = spark.sql(
        """SELECT '2021-03-01T23:59:59Z' AS s, timestamp'2021-03-01 23:59:59Z' AS t,
        timestamp_ntz'2021-03-01 23:59:59' AS n, date'2021-03-01' AS d,
        timestamp'1969-12-31 23:59:59Z' AS old, 'nonsense' AS bad"""
    )
    got = df.select(*[utc_day(df, c).alias(c) for c in df.columns]).first()
    assert set(got[:4]) == {dt.date(2021, 3, 1)}
    assert got["old"] == dt.date(1969, 12, 31) and got["bad"] is None


def test_flow_files_are_read_by_column_name(spark, write, tmp_path):
    write("flightlist_20210101_20210131.csv.gz", "day,origin,destination,x", "2021-01-01,A,B,1")
    got = readers.read_flows(spark, str(tmp_path), "202101")
    assert rows(got) == [("2021-01-01", "A", "B")]


def test_flow_file_with_other_column_order_is_not_misread(spark, write, tmp_path):
    write("flightlist_20210101_20210131.csv.gz", "day,origin,destination", "2021-01-01,A,B")
    write("flightlist_20210201_20210228.csv.gz", "origin,day,destination", "A,2021-02-01,B")
    with pytest.raises(Exception, match="header|column"):
        readers.read_flows(spark, str(tmp_path), "2021").collect()


def test_dimensions(spark, write):
    codes = write(
        "countries.csv",
        "English short name lower case,Alpha-2 code,Alpha-3 code,Numeric code,ISO 3166-2",
        '"Bolivia, Plurinational State of",BO,BOL,068,ISO 3166-2:BO',
        "Åland Islands,AX,ALA,248,ISO 3166-2:AX",
        "Namibia,NA,NAM,516,ISO 3166-2:NA",
    )
    assert rows(readers.read_codes(spark, codes), "country_code", "country") == [
        ("AX", "Åland Islands"),
        ("BO", "Bolivia, Plurinational State of"),
        ("NA", "Namibia"),
    ]
    facilities = write("airports.csv", "icao,iata,country", "FYWH,WDH,NA")
    assert rows(readers.read_facilities(spark, facilities)) == [("FYWH", "NA")]


MONTH_HEADER = (
    "year_month,Country_Region,Confirmed_cumulative,Deaths_cumulative,Recovered_cumulative,"
    "Active_cumulative,Confirmed_monthly_new,Deaths_monthly_new,Recovered_monthly_new,"
    "Active_monthly_new"
)


def test_monthly_cases_keep_month_text_and_whole_numbers(spark, write, tmp_path):
    write("a_US.csv", MONTH_HEADER, "2021-01,US,12,0.0,,5,1,2,,4")
    write("b_US.csv", MONTH_HEADER, "2021-02,US,13,1.0,,5,1,2,,4")
    got = readers.read_monthly_cases(spark, f"{tmp_path}/*_US.csv")
    assert rows(got, *got.columns[:6]) == [
        ("2021-01", "US", 12, 0, None, 5),
        ("2021-02", "US", 13, 1, None, 5),
    ]
    assert dict(got.dtypes)["Deaths_cumulative"] == "bigint"
    assert {r[0].rsplit("/", 1)[1] for r in rows(got, "source_file")} == {"a_US.csv", "b_US.csv"}


def test_batch_written_twice_counts_once_and_spares_others(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("2021-01", 1)], "month string, n long")
    write_batch(one, path, batch="202101")
    write_batch(one.withColumn("n", F.lit(9).cast("long")), path, batch="202102")
    write_batch(one, path, batch="202101", areas="US")
    write_batch(one, path, batch="202101", sort=["month"])
    got = readers.read_partitioned(spark, path, one.schema, RESULT_PARTITIONS)
    assert rows(got) == [
        ("2021-01", 1, "US", "202101"),
        ("2021-01", 1, "all", "202101"),
        ("2021-01", 9, "all", "202102"),
    ]


def test_csv_export_is_sorted_over_its_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(spark.range(1000).select(F.col("id").cast("string").alias("k")), path, sort=["k"])
    text = [
        line
        for part in sorted((tmp_path / "csv").glob("part-*.csv"))
        for line in part.read_text().splitlines()[1:]
    ]
    assert text == sorted(map(str, range(1000)))


def test_landed_rows_are_whole_and_pruned(spark, tmp_path):
    path = str(tmp_path / "landed")
    # One month holds a third of the rows, and some rows have no day.
    raw = spark.range(3000).select(
        "id",
        F.when(F.col("id") < 1000, F.lit("2021-01-15"))
        .when(F.col("id") < 2900, F.date_add(F.lit("2021-02-01"), (F.col("id") % 300).cast("int")))
        .cast("string")
        .alias("day"),
    )
    land_by_month(raw, path, "day")
    back = readers.read_partitioned(spark, path, raw.schema, ["year_month"])
    assert back.count() == 3000 and back.filter("year_month IS NULL").count() == 100
    january = back.filter("year_month = '2021-01'")
    assert january.count() == 1000
    assert "PartitionFilters: [isnotnull(year_month" in january._jdf.queryExecution().toString()
