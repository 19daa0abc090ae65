from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.deltas import step_changes
from tallyflow.operators.filters import abnormal_days, plausible_areas, valid_days
from tallyflow.operators.quality import abnormal_sample, day_audit, null_profile
from tallyflow.operators.rollups import ROWS, area_day_totals, area_months
from tallyflow.plans.snapshots import area_day_table, area_month_table, days_from_totals
from tallyflow.schemas import SnapshotSpec
from tests.conftest import rows

SPEC = SnapshotSpec()
REPORT = (
    "Country_Region string, Last_Update timestamp, Confirmed int, Deaths int, "
    "Recovered int, Active int"
)


def reports(spark, *values):
    """Reports of (area, day, confirmed, recovered)."""
    data = [
        (
            area,
            day and dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc),
            c,
            0,
            r,
            None,
        )
        for area, day, c, r in values
    ]
    return spark.createDataFrame(data, REPORT)


def test_change_is_taken_within_an_area(spark):
    raw = reports(
        spark,
        ("US", "2021-01-01", 60, 1),
        ("US", "2021-01-01", 40, 1),
        ("FR", "2021-01-01", 10, None),
        ("US", "2021-01-02", 150, 5),
        ("FR", "2021-01-02", 12, None),
    )
    got = rows(
        area_day_table(raw),
        "Country_Region",
        "date",
        "Confirmed_cumulative",
        "Confirmed_daily_new",
        "Recovered_daily_new",
    )
    one, two = dt.date(2021, 1, 1), dt.date(2021, 1, 2)
    assert got == [
        ("FR", one, 10, None, None),
        ("FR", two, 12, 2, None),
        ("US", one, 100, None, None),
        ("US", two, 150, 50, 3),
    ]
    assert rows(area_day_table(raw, areas=["FR"]), "Country_Region") == [("FR",)] * 2
    assert rows(area_day_table(raw, areas=[])) == rows(area_day_table(raw))


def test_year_bounds_are_the_same_for_report_and_filter(spark):
    days = ["2019-12-31", "2020-01-01", "2024-03-02", "2024-12-31", "2025-01-01", None]
    raw = reports(spark, *[("US", d, 1, 1) for d in days])
    kept = rows(area_day_table(raw), "date")
    assert [d.isoformat() for (d,) in kept] == ["2020-01-01", "2024-03-02", "2024-12-31"]
    assert abnormal_days(raw, "Last_Update", SPEC).count() == 3
    assert valid_days(raw, "Last_Update", SPEC).count() == 3
    audit = day_audit(raw, "Last_Update", SPEC).first()
    assert (audit["rows"], audit["abnormal_days"], audit["abnormal_days_pct"]) == (6, 3, 50.0)
    assert abnormal_sample(raw, "Last_Update", SPEC, ["Last_Update"], 2).count() == 2


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "string", "timestamp"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_year_bounds_for_each_type_of_day(spark, conf, kind, zone):
    with conf(spark__sql__session__timeZone=zone):
        df = spark.createDataFrame(
            [("2019-12-31",), ("2020-01-01",), ("2024-12-31",), ("2025-01-01",)], "d string"
        )
        text = F.concat("d", F.lit("T00:00:00Z")) if kind == "timestamp" else F.col("d")
        typed = df.withColumn("t", text.cast(kind))
        assert rows(valid_days(typed, "t", SPEC), "d") == [("2020-01-01",), ("2024-12-31",)]


def test_numbered_areas_are_dropped_and_reported(spark):
    raw = reports(spark, ("300", "2021-01-01", 1, 1), ("US", "2021-01-01", 2, 1), (None, "2021-01-01", 3, 1))
    assert rows(area_day_table(raw), "Country_Region") == [(None,), ("US",)]
    assert plausible_areas(raw, "Country_Region").count() == 2
    assert day_audit(raw, "Last_Update", SPEC).first()["numbered_areas"] == 1


def test_month_takes_the_largest_value_or_the_last(spark):
    raw = reports(
        spark,
        ("US", "2020-11-05", 1, 10),
        ("US", "2020-11-20", 5, 12),
        ("US", "2020-11-30", 7, 0),
        ("US", "2020-12-01", 9, 0),
    )
    columns = ["year_month", "Recovered_cumulative", "Confirmed_monthly_new"]
    assert rows(area_month_table(raw), *columns) == [("2020-11", 12, 6), ("2020-12", 0, 2)]
    last = area_month_table(raw, closing="last")
    assert rows(last, *columns) == [("2020-11", 0, 6), ("2020-12", 0, 2)]
    with pytest.raises(ValueError):
        area_months(area_day_table(raw), SPEC, closing="first")


def test_empty_share_is_null(spark):
    audit = day_audit(reports(spark), "Last_Update", SPEC).first()
    assert audit.asDict() == {
        "rows": 0,
        "abnormal_days": 0,
        "abnormal_days_pct": None,
        "numbered_areas": 0,
    }
    weighted = area_day_totals(reports(spark), SPEC)
    assert day_audit(weighted, "date", SPEC, weight=ROWS).first()["abnormal_days_pct"] is None


def test_audit_of_totals_equals_audit_of_reports(spark):
    raw = reports(
        spark,
        ("US", "2021-01-01", 1, 1),
        ("US", "2021-01-01", 1, 1),
        ("300", "2021-01-01", 1, 1),
        ("US", None, 1, 1),
        ("US", "2615-01-01", 1, 1),
        ("US", "2615-01-01", 1, 1),
    )
    totals = area_day_totals(raw, SPEC)
    expected = day_audit(raw, "Last_Update", SPEC).first()
    assert day_audit(totals, "date", SPEC, weight=ROWS).first() == expected
    assert expected["abnormal_days"] == 3 and expected["numbered_areas"] == 1
    # Abnormal and kept rows make up the input.
    kept = valid_days(totals, "date", SPEC).agg(F.sum(ROWS)).first()[0]
    assert kept + expected["abnormal_days"] == expected["rows"]
    assert rows(days_from_totals(totals, SPEC)) == rows(area_day_table(raw))


def test_null_profile(spark):
    df = spark.createDataFrame([(None, 1), ("x", None), (None, 2)], "c string, n int")
    assert null_profile(df).first().asDict() == {"c": 2, "n": 1}
    weighted = df.withColumn("w", F.lit(5))
    assert null_profile(weighted, "w").first().asDict() == {"c": 10, "n": 5}
    odd = df.withColumnRenamed("c", "a.b/`c")
    assert null_profile(odd).first().asDict() == {"a.b/`c": 2, "n": 1}


def test_changes_add_up_to_last_less_first_and_use_one_window(spark, conf):
    values = [("A", f"2021-{m:02d}-{d:02d}", (m * 37 + d * 11) % 90, d) for m in (1, 2, 3) for d in range(1, 29)]
    raw = reports(spark, *values, *[("B", day, v + 1, r) for _, day, v, r in values])
    days = area_day_table(raw)
    total = days.groupBy("Country_Region").agg(
        F.sum("Confirmed_daily_new").alias("sum"),
        (F.max_by("Confirmed_cumulative", "date") - F.min_by("Confirmed_cumulative", "date")).alias("gap"),
    )
    assert all(a == b for a, b in rows(total, "sum", "gap"))
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and "SinglePartition" not in plan
    expected = rows(days)
    with conf(spark__sql__shuffle__partitions="1"):
        assert rows(area_day_table(raw)) == expected
    with conf(spark__sql__shuffle__partitions="13", spark__sql__session__timeZone="Asia/Tokyo"):
        assert rows(area_day_table(raw)) == expected


def test_one_area_with_a_third_of_all_reports(spark):
    """The window sees one row per day, however many reports an area has."""
    raw = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("area "), (F.col("id") % 50).cast("string")))
        .alias("Country_Region"),
        F.timestamp_seconds(F.lit(1609459200) + (F.col("id") % 20) * 86400).alias("Last_Update"),
        *[F.lit(1).alias(m) for m in SPEC.measures],
    )
    days = area_day_table(raw)
    hot = days.filter("Country_Region = 'hot'")
    assert hot.count() == 20
    assert hot.agg(F.sum("Confirmed_cumulative")).first()[0] == 10000
    assert days.agg(F.sum("Confirmed_cumulative")).first()[0] == 30000


def test_step_changes_with_gaps(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 9)], "k string, t int, v int")
    assert rows(step_changes(df, "k", "t", {"d": "v"}), "t", "d") == [
        (1, None),
        (2, None),
        (3, None),
    ]
