from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.lookups import place_table
from tallyflow.plans.flows import count_flows, map_flows
from tallyflow.plans.marts import cases_with_flows
from tallyflow.plans.snapshots import area_day_table
from tallyflow.schemas import SnapshotSpec
from tallyflow.streaming.joined_months import append_rows, late_rows, streamed_cases_with_flows
from tallyflow.streaming.running_counts import daily_counts, keep_updated, latest_counts, next_query
from tallyflow.streaming.running_days import keep_days_updated, latest_days, running_totals
from tests.conftest import rows

SCHEMA = "ts string, kind string"


def feed(write, name, *lines):
    write(f"in/{name}.csv", *lines)


def read(spark, tmp_path, ddl=SCHEMA):
    return spark.readStream.schema(ddl).csv(f"{tmp_path}/in")


@pytest.mark.parametrize("late_after", [None, "40 days"])
def test_counts_grow_as_files_arrive(spark, write, tmp_path, late_after):
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        stream = read(spark, tmp_path).withColumn("ts", F.col("ts").cast("timestamp"))
        counts = daily_counts(stream, "ts", ["kind"], late_after)
        keep_updated(counts, out, checkpoint).awaitTermination()
        return rows(latest_counts(spark, out, ["day", "kind"]))

    feed(write, "a", "2021-01-01 10:00:00,x", "2021-01-01 11:00:00,x", "2021-01-02 10:00:00,y")
    first = [(dt.date(2021, 1, 1), "x", 2), (dt.date(2021, 1, 2), "y", 1)]
    assert run() == first
    # Nothing new: nothing changes.
    assert run() == first
    # A later file holds rows of an earlier day.
    feed(write, "b", "2021-01-01 23:59:59,x", "2021-01-03 00:00:00,x")
    assert run() == [
        (dt.date(2021, 1, 1), "x", 3),
        (dt.date(2021, 1, 2), "y", 1),
        (dt.date(2021, 1, 3), "x", 1),
    ]


def test_flows_of_a_stream_use_the_batch_operators(spark, write, tmp_path):
    facilities = spark.createDataFrame([("KJFK", "US"), ("LFPG", "FR")], "icao string, country string")
    codes = spark.createDataFrame([("US", "United States"), ("FR", "France")], "country_code string, country string")
    places = place_table(facilities, codes)
    out = f"{tmp_path}/out"
    columns = "day string, origin string, destination string"
    for name in ("a", "b"):
        feed(write, name, "2021-01-01,LFPG,KJFK", "2021-01-01,KJFK,KJFK", "2021-01-02,,KJFK")
        counts = count_flows(map_flows(read(spark, tmp_path, columns), places), "origin", "year_month")
        keep_updated(counts, out, f"{tmp_path}/checkpoint").awaitTermination()
    keys = [c for c in counts.columns if c != "flight_count"]
    latest = latest_counts(spark, out, keys, "flight_count")
    assert rows(latest, "year_month", "origin_country", "flight_count") == [("2021-01", "France", 2)]


def test_compaction_and_a_lost_checkpoint(spark, write, tmp_path):
    out = f"{tmp_path}/out"

    def run(checkpoint):
        counts = daily_counts(read(spark, tmp_path), "ts", ["kind"])
        query = keep_updated(
            counts, out, checkpoint, ["day", "kind"], compact_every=2, trigger={"availableNow": True}
        )
        query.awaitTermination()
        return rows(latest_counts(spark, out, ["day", "kind"]))

    day = dt.date(2021, 1, 1)
    want = []
    for n, name in enumerate("abc", start=1):
        feed(write, name, "2021-01-01 10:00:00,x", f"2021-01-01 10:00:00,only {name}")
        want.append((day, f"only {name}", 1))
        assert run(f"{tmp_path}/checkpoint") == [*want, (day, "x", n)]
    assert spark.read.parquet(out).filter("whole = 'true'").count() > 0
    # A new query counts from the start, and its numbers replace the old ones.
    feed(write, "d", "2021-01-01 10:00:00,x")
    assert run(f"{tmp_path}/other") == [*want, (day, "x", 4)]


def test_the_later_query_counts_whatever_the_clock_says(spark, write, tmp_path, monkeypatch):
    import time

    out = f"{tmp_path}/out"
    assert int(next_query(spark, out)) == 1
    day = dt.date(2021, 1, 1)
    for n, now in ((1, 10**18), (2, 5)):
        monkeypatch.setattr(time, "time_ns", lambda now=now: now)
        feed(write, f"f{n}", "2021-01-01 10:00:00,x")
        counts = daily_counts(read(spark, tmp_path), "ts", ["kind"])
        keep_updated(counts, out, f"{tmp_path}/checkpoint{n}").awaitTermination()
        assert rows(latest_counts(spark, out, ["day", "kind"])) == [(day, "x", n)]
        assert int(next_query(spark, out)) == n + 1


def test_a_whole_table_after_a_lost_checkpoint_holds_what_was_before(spark, write, tmp_path):
    """The first micro-batch of the new query sees one file of three."""
    out, day = f"{tmp_path}/out", dt.date(2021, 1, 1)
    for name in "abc":
        feed(write, name, f"2021-01-01 10:00:00,{name}")
    keep_updated(daily_counts(read(spark, tmp_path), "ts", ["kind"]), out, f"{tmp_path}/one").awaitTermination()
    one_file = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "b.csv").csv(f"{tmp_path}/in")
    counts = daily_counts(one_file, "ts", ["kind"])
    keep_updated(counts, out, f"{tmp_path}/two", ["day", "kind"], compact_every=1).awaitTermination()
    assert rows(latest_counts(spark, out, ["day", "kind"])) == [(day, k, 1) for k in "abc"]


REPORTS = "Country_Region string, Last_Update timestamp_ntz, Confirmed int, Deaths int, Recovered int, Active int"


@pytest.mark.parametrize("compact_every", [0, 2])
def test_days_of_a_stream_in_any_order(spark, write, tmp_path, compact_every):
    """After every file the table equals that of a batch over the files so far."""
    import random

    rng = random.Random(7)
    out, spec = f"{tmp_path}/out", SnapshotSpec()
    columns = ["Country_Region", "date", *spec.cumulative, *spec.daily_new]
    for n in range(5):
        lines = [f"{rng.choice(['US', 'FR', '', '300'])},2021-01-{rng.randint(1, 20):02d} 05:00:00,{rng.randrange(90)},,{rng.choice(['', 3])},1" for _ in range(12)]
        feed(write, f"f{n}", *lines, "US,2031-01-01 00:00:00,5,5,5,5")
        totals = running_totals(read(spark, tmp_path, REPORTS), spec)
        keep_days_updated(totals, out, f"{tmp_path}/checkpoint", spec, compact_every).awaitTermination()
        whole = area_day_table(spark.read.schema(REPORTS).csv(f"{tmp_path}/in"), spec)
        assert rows(latest_days(spark, out, spec), *columns) == rows(whole, *columns)
    # A revision is written for a changed day and the next one, not for the whole area.
    log = spark.read.parquet(out).filter("whole = 'false'")
    assert log.count() < 5 * whole.count()


def test_a_late_row_moves_two_days(spark, write, tmp_path):
    out, spec = f"{tmp_path}/out", SnapshotSpec()

    def run():
        keep_days_updated(running_totals(read(spark, tmp_path, REPORTS), spec), out, f"{tmp_path}/checkpoint", spec).awaitTermination()

    feed(write, "a", *[f"US,2021-01-0{d} 05:00:00,{10 * d},,," for d in (1, 3, 5, 7)], "FR,2021-01-01 05:00:00,1,,,")
    run()
    feed(write, "b", "US,2021-01-04 05:00:00,35,,,")
    run()
    second = spark.read.parquet(out).filter("batch_id = 1")
    assert rows(second, "Country_Region", "date", "Confirmed_daily_new") == [("US", dt.date(2021, 1, 4), 5), ("US", dt.date(2021, 1, 5), 15)]


def test_a_stream_join_of_cases_and_flows(spark, write, tmp_path):
    cases, flows = "month string, country string, Confirmed_cumulative long", "month string, end_country string, flight_count long"
    months = [f"2020-{m:02d}" for m in range(1, 13)]
    case_rows = [(m, c, i) for i, m in enumerate(months) for c in ("US", "FR")]
    flow_rows = [(m, c, 10 * i) for i, m in enumerate(months) for c in ("United States", "Spain") if i % 3]

    def out():
        queries = {}
        for name, ddl in (("cases", cases), ("flows", flows)):
            queries[name] = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).csv(f"{tmp_path}/{name}")
        query = append_rows(streamed_cases_with_flows(queries["cases"], queries["flows"]), f"{tmp_path}/joined", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        return query, spark.read.schema(f"{cases}, flight_count long").parquet(f"{tmp_path}/joined").filter("month < '2999'")

    for part in range(3):
        own = months[4 * part : 4 * part + 4]
        write(f"cases/{part}.csv", *[f"{m},{c},{n}" for m, c, n in case_rows if m in own])
        write(f"flows/{part}.csv", *[f"{m},{c},{n}" for m, c, n in flow_rows if m in own])
        query, found = out()
        assert late_rows(query) == 0
    # The last months still wait for flows.
    assert found.filter("month = '2020-12' AND country = 'FR'").count() == 0
    write("cases/z.csv", "2999-01,US,1")
    write("flows/z.csv", "2999-01,Spain,1")
    found = out()[1]
    whole = cases_with_flows(spark.createDataFrame(case_rows, cases), spark.createDataFrame(flow_rows, flows))
    assert rows(found, "month", "country", "Confirmed_cumulative", "flight_count") == rows(whole, "month", "country", "Confirmed_cumulative", "flight_count")
    # Flows after the watermark are counted, and change nothing.
    write("flows/late.csv", "2020-01,United States,99", "2020-04,Spain,99")
    query, again = out()
    assert late_rows(query) == 2 and rows(again) == rows(found)
