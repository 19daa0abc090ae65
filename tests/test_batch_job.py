from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyflow.plans.batch_job import BatchInputs, run_batch
from tallyflow.plans.marts import marts_from_results
from tallyflow.session import shared_folder, stage_path
from tallyflow.sources.readers import read_partitioned
from tests.conftest import rows
from tests.test_sources import HEADER, OLD_HEADER, report


@pytest.fixture
def inputs(write, tmp_path):
    write(
        "reports/12-31-2020.csv",
        HEADER,
        report("US", "2020-12-31 05:00:00", 90),
        report("France", "2020-12-31 05:00:00", 9),
    )
    write(
        "reports/01-01-2021.csv",
        HEADER,
        report("US", "2021-01-01 05:00:00", 60),
        report("US", "2021-01-01 06:00:00", 40),
        report("France", "2021-01-01 05:00:00", 10),
        report("300", "2021-01-01 05:00:00", 1),
        report("US", "2615-01-01 05:00:00", 1),
        report("US", "2021-01-01 05:00:00", "many"),
    )
    write("reports/01-02-2021.csv", OLD_HEADER, "A,US,2021-01-02,65187,2615,20969")
    write(
        "reports/2021-01-03.csv",
        HEADER,
        report("US", "2021-01-03 05:00:00", 150),
        report("France", "2021-01-03 05:00:00", 12),
    )
    write(
        "flights/flightlist_20210101_20210131.csv.gz",
        "callsign,origin,destination,day",
        "a,LFPG,KJFK,2021-01-01 00:00:00+00:00",
        "b,LFPG,KJFK,2021-01-01 00:00:00+00:00",
        "c,KJFK,LFPG,2021-01-05 00:00:00+00:00",
        "d,KJFK,KJFK,2021-01-05 00:00:00+00:00",
        "e,,KJFK,2021-01-05 00:00:00+00:00",
        "f,FYWH,KJFK,2020-12-30 00:00:00+00:00",
    )
    airports = write("airports.csv", "icao,name,country", "KJFK,x,US", "KJFK,x,US", "LFPG,x,FR", "FYWH,x,NA")
    countries = write(
        "countries.csv",
        "English short name lower case,Alpha-2 code,Alpha-3 code",
        "United States,US,USA",
        "France,FR,FRA",
        "Namibia,NA,NAM",
    )
    return BatchInputs(f"{tmp_path}/reports", f"{tmp_path}/flights", airports, countries)


def dataset(spark, path, ddl):
    schema = spark.createDataFrame([], ddl).schema
    return read_partitioned(spark, path, schema, ["areas", "batch"])


CASES = "year_month string, Country_Region string, Confirmed_cumulative long, Confirmed_monthly_new long"
FLOWS = "year_month string, origin_country string, destination_country string, flight_count long"
QUALITY = "section string, metric string, value double"


def test_run_of_one_month_for_one_country_twice(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        paths = run_batch(spark, inputs, out, "202101", ["US"])
    assert rows(dataset(spark, paths["cases"], CASES)) == [
        ("2021-01", "France", 12, 2, "all", "202101"),
        ("2021-01", "US", 150, 50, "US", "202101"),
        ("2021-01", "US", 150, 50, "all", "202101"),
    ]
    assert rows(dataset(spark, paths["flows"], FLOWS)) == [
        ("2020-12", "Namibia", "United States", 1, "US", "202101"),
        ("2021-01", "France", "United States", 2, "US", "202101"),
    ]
    lines = {
        (r.section, r.metric): r.value
        for r in dataset(spark, paths["quality"], QUALITY).collect()
    }
    assert lines["scan", "rejected_rows"] == 2
    assert lines["reports", "rows"] == 7
    assert lines["reports", "abnormal_days"] == 1
    assert lines["reports", "numbered_areas"] == 1
    assert lines["area_day_nulls", "Confirmed_daily_new"] == 2
    assert lines["flow_nulls", "origin_country"] == 1
    assert lines["facilities", "repeated_facilities"] == 1
    assert lines["names", "unmatched_names"] == 0


@pytest.mark.parametrize("areas", [None, []])
def test_no_areas_means_all(spark, inputs, tmp_path, areas):
    paths = run_batch(spark, inputs, str(tmp_path / "out"), "*", areas)
    cases = dataset(spark, paths["cases"], CASES)
    assert rows(cases.select("areas", "batch").distinct()) == [("all", "all")]
    assert rows(cases, "year_month", "Country_Region", "Confirmed_monthly_new") == [
        ("2020-12", "France", None),
        ("2020-12", "US", None),
        ("2021-01", "France", 3),
        ("2021-01", "US", 60),
    ]
    assert rows(dataset(spark, paths["flows"], FLOWS), "origin_country", "flight_count") == [
        ("France", 2),
        ("Namibia", 1),
        ("United States", 1),
    ]


def test_batches_make_marts(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    for period in ("2020", "2021"):
        run_batch(spark, inputs, out, period, ["US"])
    # A list that ends in the same name is another partition.
    run_batch(spark, inputs, out, "2021", ["France", "US"])
    marts = marts_from_results(spark, out)
    assert rows(
        marts["focus_with_flows"], "month", "Confirmed_cumulative", "Confirmed_monthly_new", "flight_count"
    ) == [("2020-12", 90, None, 1), ("2021-01", 150, 60, 2)]
    assert marts["cases_long"].count() == 2 * 2 * 8


def test_batch_without_files_writes_empty_results(spark, inputs, tmp_path):
    paths = run_batch(spark, inputs, str(tmp_path / "out"), "202305", ["US"])
    lines = dataset(spark, paths["quality"], QUALITY).filter("section = 'reports'")
    assert rows(lines.filter("metric <> 'abnormal_days_pct'").select(F.sum("value"))) == [(0.0,)]


def test_raw_files_are_scanned_once(spark, inputs, tmp_path, monkeypatch):
    from tallyflow.plans import batch_job

    scans = []
    real = batch_job.staged
    monkeypatch.setattr(batch_job, "staged", lambda df, *at: scans.append(df) or real(df, *at))
    run_batch(spark, inputs, str(tmp_path / "out"), "2021", ["US"])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in scans]
    assert plans[0].count("Relation [") == 1
    assert plans[1].count("Relation [callsign") == 1


def test_period_is_checked_before_any_work(spark, inputs, tmp_path):
    with pytest.raises(ValueError):
        run_batch(spark, inputs, str(tmp_path / "out"), "January")


def test_stages_go_to_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert stage_path(spark, "x") != stage_path(spark, "x")
