"""Layouts by header, revisions across files, and runs that read changed files only."""

from __future__ import annotations

import datetime as dt
import time
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyflow import schemas
from tallyflow.operators.rollups import area_day_totals
from tallyflow.plans.batch_job import run_batch
from tallyflow.plans.incremental import current_ledger, input_files, refresh_totals
from tallyflow.sources import layouts, readers
from tallyflow.sources.batches import report_day
from tests.conftest import rows
from tests.test_batch_job import CASES, QUALITY, dataset, inputs  # noqa: F401
from tests.test_sources import HEADER, OLD_HEADER, report

EIGHT = OLD_HEADER + ",Latitude,Longitude"
TWELVE = ",".join(HEADER.split(",")[:12])
RENAMED = HEADER.replace("Incident_Rate", "Incidence_Rate").replace("Case_Fatality_Ratio", "Case-Fatality_Ratio")


@pytest.fixture
def folder(write, tmp_path):
    write("01-22-2020.csv", "﻿" + OLD_HEADER, "Anhui,China,1/22/2020 17:00,1,,", "Hubei,China,1/22/20 9:05,444,17,28")
    write("03-08-2020.csv", EIGHT, "Hubei,China,2020-03-08T14:43:03,67707,2986,45235,30.97,112.27")
    write("04-01-2020.csv", TWELVE, '1,Adm,Prov,US,2020-04-01 21:58:49,1.5,2.5,4,0,0,4,"Adm, Prov"')
    write("06-01-2020.csv", RENAMED, report("US", "2020-06-02 04:33:00", 20))
    write("2020-12-01.csv", "Confirmed,Other,Last_Update,Country_Region", "7,x,2020-12-01 05:00:00,FR", "8,x,FR")
    write("12-02-2020.csv", "a,b", "1,2", "3,4")
    write("12-03-2020.csv", HEADER, report("US", "yesterday"), report("US", confirmed="many"), report("US", "2020-12-03", 30))
    return str(tmp_path)


def test_files_are_read_by_their_headers(spark, folder):
    found = layouts.read_reports_by_header(spark, folder)
    stamp = F.date_format("Last_Update", "yyyy-MM-dd HH:mm:ss").alias("stamp")
    assert rows(found.select("Country_Region", "Province_State", stamp, *schemas.MEASURES)) == sorted(
        [
            ("China", "Anhui", "2020-01-22 17:00:00", 1, None, None, None),
            ("China", "Hubei", "2020-01-22 09:05:00", 444, 17, 28, None),
            ("China", "Hubei", "2020-03-08 14:43:03", 67707, 2986, 45235, None),
            ("US", "Prov", "2020-04-01 21:58:49", 4, 0, 0, 4),
            ("US", "Prov", "2020-06-02 04:33:00", 20, 1, 2, 7),
            ("FR", None, "2020-12-01 05:00:00", 7, None, None, None),
            ("US", "Prov", "2020-12-03 00:00:00", 30, 1, 2, 7),
        ],
        key=lambda r: tuple(map(str, r)),
    )
    assert rows(layouts.read_reports_by_header(spark, folder, "202004").select("Confirmed")) == [(4,)]
    assert layouts.read_reports_by_header(spark, folder, "1999").count() == 0


def test_what_no_layout_fits_is_counted_and_listed(spark, folder):
    found = layouts.routed(layouts.file_headers(spark, f"{folder}/*.csv"))
    assert {f.rsplit("/", 1)[1]: h for f, h in found.unknown.items()} == {"12-02-2020.csv": "a,b"}
    assert sorted(len(c) for c in found.groups) == [4, 6, 8, 12, 14]
    counts = readers.layout_profile(layouts.read_routed(spark, found))
    name = F.regexp_extract(schemas.SOURCE, "([^/]+)$", 1)
    assert rows(counts.filter("_layout = 0 OR report_rows > 1").select(name, "_layout", "report_rows", "dated_rows")) == [
        ("01-22-2020.csv", 6, 2, 2),
        ("12-02-2020.csv", 0, 2, 0),
        # A bad value counts only where its column is used.
        ("12-03-2020.csv", 0, 1, 0),
        ("12-03-2020.csv", 14, 2, 2),
        ("2020-12-01.csv", 0, 1, 0),
    ]


@pytest.mark.parametrize(
    "header, columns",
    [
        ("Country/Region,Last Update,Confirmed", ("Country_Region", "Last_Update", "Confirmed")),
        ("Confirmed,Country_Region,LAST UPDATE,x", ("Confirmed", "Country_Region", "Last_Update", "")),
        ('"Country_Region","Last_Update",Confirmed', ("Country_Region", "Last_Update", "Confirmed")),
        ("Country_Region,Confirmed", None),
        ("Country_Region,Country/Region,Last_Update,Confirmed", None),
        ("", None),
    ],
)
def test_names_of_a_header(header, columns):
    assert layouts.columns_of(header) == columns


def test_a_run_has_the_months_of_early_2020(spark, inputs, write, tmp_path):  # noqa: F811
    write("reports/02-26-2020.csv", OLD_HEADER, "Hubei,US,2020-02-26T14:13:10,5,1,1", "Hubei,US,2/27/2020 8:00,9,1,1")
    write("reports/02-28-2020.csv", "x,y", "1,2")
    paths = run_batch(spark, inputs, str(tmp_path / "out"), "2020", layouts="header")
    cases = dataset(spark, paths["cases"], CASES).filter("Country_Region = 'US'")
    assert rows(cases.select("year_month", "Confirmed_cumulative", "Confirmed_monthly_new")) == [("2020-02", 9, 4), ("2020-12", 90, 81)]
    lines = dataset(spark, paths["quality"], QUALITY)
    assert rows(lines.filter("section IN ('unknown_header', 'scan')").select("metric", "value")) == [
        ("02-28-2020.csv: x,y", 1.0),
        ("rejected_rows", 1.0),
    ]


def test_the_latest_report_of_a_place_and_day_counts(spark, write, tmp_path):
    stale = report("US", "2021-01-02 01:00:00", 5)
    write("01-02-2021.csv", HEADER, stale, report("FR", "2021-01-02 01:00:00", 1))
    write("2021-01-03.csv", HEADER, stale, report("US", "2021-01-02 03:00:00", 8), report("US", "2021-01-03 01:00:00", 20))
    write("01-04-2021.csv", HEADER, stale.replace("Adm,", "Other,"), "x,y", report("US", "2021-01-03 01:00:00", 30))
    reports = readers.read_reports(spark, str(tmp_path), rejects=True)
    totals = area_day_totals(reports, schemas.SnapshotSpec(), revisions="latest", version=report_day(F.col(schemas.SOURCE)))
    day = F.date_format("date", "dd").alias("day")
    assert rows(totals.select(day, "Country_Region", "Confirmed", "report_rows", "rejected_rows", "superseded_rows")) == [
        ("02", "FR", 1, 1, 0, 0),
        ("02", "US", 8 + 5, 2, 0, 2),
        ("03", "US", 30, 1, 0, 1),
        (None, None, None, 0, 1, 0),
    ]
    every = area_day_totals(reports, schemas.SnapshotSpec())
    assert rows(every.filter("Country_Region = 'US'").select(day, "Confirmed")) == [("02", 23), ("03", 50)]
    with pytest.raises(ValueError):
        area_day_totals(reports, schemas.SnapshotSpec(), revisions="newest")


def test_order_of_versions_is_that_of_days_in_file_names(spark):
    names = ["a/01-02-2021.csv", "b/2020-12-31.csv", "b/12-01-2020.csv/part-0.csv", "x.csv", "b/13-45-2020.csv"]
    found = spark.createDataFrame([(n,) for n in names], "file string").select(report_day(F.col("file")))
    assert [r[0] for r in found.collect()] == [dt.date(2021, 1, 2), dt.date(2020, 12, 31), dt.date(2020, 12, 1), None, None]


def test_a_long_path_is_gone_through_once(spark):
    """Each letter of a path without the name looked for must not start another search."""
    long = "a" * 60_000
    names = [f"{long}{i}/01-02-2021.csv" for i in range(10)] + [f"{long}{i}.csv" for i in range(10)]
    found = spark.createDataFrame([(n,) for n in names], "file string").select(report_day(F.col("file")))
    start = time.perf_counter()
    assert [r[0] for r in found.collect()] == [dt.date(2021, 1, 2)] * 10 + [None] * 10
    assert time.perf_counter() - start < 10


def test_a_hot_area_is_spread_by_place(spark):
    """Rows of one area are grouped by place and day before they meet."""
    from tallyflow.operators.rollups import latest_reports

    df = spark.range(1000).selectExpr("'US' AS area", "id % 200 AS place", "id AS version", "id AS value")
    plan = latest_reports(df, ["area", "place"], ["version"], ["value"])._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\((US|area)[^)]*place", plan)


def spread(df):
    return rows(df.selectExpr("date", "Country_Region", "Confirmed", "Recovered", "report_rows", "rejected_rows"))


def test_a_second_run_reads_changed_files_only(spark, write, tmp_path):
    seen = []

    def read(files):
        seen.append(sorted(f.rsplit("/", 1)[1] for f in files))
        return readers.read_report_files(spark, files)

    glob, store = f"{tmp_path}/in put/*.csv", f"{tmp_path}/store"
    refresh = lambda: refresh_totals(spark, glob, store, read)
    full = lambda: area_day_totals(readers.read_report_files(spark, glob), schemas.SnapshotSpec())

    none = refresh()
    assert none.totals.count() == 0 and none.run == 1 and seen == []
    for day in (1, 2, 3):
        write(f"in put/01-0{day}-2021.csv", HEADER, report("US", f"2021-01-0{day}", day), report("FR", "2021-01-01", 1), "bad,line")
    first = refresh()
    assert (first.run, first.read, first.taken_away) == (2, 3, 0)
    assert spread(first.totals) == spread(full())
    again = refresh()
    assert (again.run, again.read) == (2, 0) and spread(again.totals) == spread(full())

    time.sleep(0.01)
    changed = write("in put/01-02-2021.csv", HEADER, report("US", "2021-01-02", 70), report("DE", "2021-01-02", ""))
    second = refresh()
    assert seen[-1] == ["01-02-2021.csv"] and (second.read, second.taken_away) == (1, 1)
    assert spread(second.totals) == spread(full())

    os.remove(changed)
    third = refresh()
    assert (third.read, third.taken_away) == (0, 1) and len(seen) == 2
    assert spread(third.totals) == spread(full())
    assert current_ledger(spark, store)[0] == 4
    os.remove(f"{tmp_path}/in put/01-01-2021.csv")
    os.remove(f"{tmp_path}/in put/01-03-2021.csv")
    assert refresh().totals.count() == 0 and refresh().totals.count() == 0


def test_a_run_that_broke_off_is_done_again(spark, write, tmp_path):
    """Partials and totals without a ledger do not count."""
    glob, store = f"{tmp_path}/in/*.csv", f"{tmp_path}/store"
    write("in/01-01-2021.csv", HEADER, report("US", "2021-01-01", 1))

    def read(files):
        return readers.read_report_files(spark, files)

    refresh_totals(spark, glob, store, read)
    write("in/01-02-2021.csv", HEADER, report("US", "2021-01-02", 2))
    refresh_totals(spark, glob, store, read)
    import shutil

    shutil.rmtree(f"{store}/ledger/run=2")
    again = refresh_totals(spark, glob, store, read)
    assert (again.run, again.read) == (2, 1)
    assert [r[2] for r in spread(again.totals)] == [1, 2]


def test_a_listing_opens_no_file(spark, write, tmp_path):
    write("in/a.csv", "x")
    listed = input_files(spark, f"{tmp_path}/in/*")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert listed.first()["size"] == 2


@pytest.mark.parametrize("layout", ["declared", "header"])
def test_a_batch_run_with_a_store(spark, inputs, write, tmp_path, layout):  # noqa: F811
    results = []
    write("reports/12-25-2020.csv", "x,y", "1,2")
    for run in range(3):
        if run == 2:
            write("reports/2021-01-03.csv", HEADER, report("US", "2021-01-03 05:00:00", 170))
        plain = run_batch(spark, inputs, f"{tmp_path}/plain{run}", layouts=layout)
        kept = run_batch(spark, inputs, f"{tmp_path}/kept{run}", layouts=layout, store=f"{tmp_path}/store")
        for name, ddl in {"cases": CASES, "quality": QUALITY}.items():
            assert rows(dataset(spark, kept[name], ddl)) == rows(dataset(spark, plain[name], ddl))
        results.append(rows(dataset(spark, kept["cases"], CASES)))
    assert results[0] == results[1] != results[2]
    with pytest.raises(ValueError):
        run_batch(spark, inputs, f"{tmp_path}/x", store=f"{tmp_path}/store", revisions="latest")
