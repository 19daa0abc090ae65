"""Gaps and falls of running totals, and indexes over ranges of months."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.deltas import carried_resets, filled_days, reset_events, step_changes
from tallyflow.operators.rollups import area_day_totals, correlation, peak_in_range, total_in_range
from tallyflow.plans.batch_job import run_batch
from tallyflow.plans.range_index import correlation_index, range_index
from tallyflow.plans.snapshots import area_day_table
from tests.conftest import rows
from tests.test_batch_job import CASES, QUALITY, dataset, inputs  # noqa: F401
from tests.test_snapshots import reports


def day(n):
    return dt.date(2021, 1, n)


@pytest.fixture
def sparse(spark):
    data = [("US", day(1), 10, 5), ("US", day(4), 20, None), ("US", day(5), 21, None), ("US", day(9), 14, 9), ("FR", day(3), 7, None), (None, day(2), 1, 1), ("US", None, 5, 5)]
    return spark.createDataFrame(data, "area string, day date, v long, w long")


def of(df, area, *columns):
    return [tuple(r) for r in df.filter(F.col("area") == area).orderBy("day").select(*columns).collect()]


def test_carried_totals(sparse):
    found = filled_days(sparse, "area", "day", ["v", "w"], "carry")
    assert found.columns == ["area", "day", "v", "w", "reported"]
    assert of(found, "US", "v") == [(x,) for x in (10, 10, 10, 20, 21, 21, 21, 21, 14)]
    assert of(found, "US", "w") == [(x,) for x in (5, 5, 5, 5, 5, 5, 5, 5, 9)]
    assert of(found, "US", "reported") == [(d in (1, 4, 5, 9),) for d in range(1, 10)]
    assert of(found, "FR", "day", "v", "w", "reported") == [(day(3), 7, None, True)]
    assert found.filter("area IS NULL").count() == 1


def test_totals_that_move_evenly(sparse):
    found = filled_days(sparse, "area", "day", ["v", "w"], "spread")
    assert of(found, "US", "v") == [(x,) for x in (10, 13, 16, 20, 21, 20, 18, 16, 14)]
    assert of(found, "US", "w") == [(x,) for x in (5, 5, 6, 6, 7, 7, 8, 8, 9)]
    with pytest.raises(ValueError):
        filled_days(sparse, "area", "day", ["v"], "guess")


@pytest.mark.parametrize("gaps", ["carry", "spread"])
def test_changes_add_up_whatever_is_missing(spark, gaps):
    rng = random.Random(4)
    data = [(f"a{a}", day(1) + dt.timedelta(days=d), rng.randrange(-50, 10**12)) for a in range(8) for d in range(400) if d in (0, 399) or rng.random() < 0.3]
    df = spark.createDataFrame(data, "area string, day date, v long")
    changed = step_changes(filled_days(df, "area", "day", ["v"], gaps), "area", "day", {"new": "v"})
    sums = {r["area"]: (r["n"], r["change"]) for r in changed.groupBy("area").agg(F.count("*").alias("n"), F.sum("new").alias("change")).collect()}
    for a in range(8):
        own = {d: v for area, d, v in data if area == f"a{a}"}
        assert sums[f"a{a}"] == (400, own[max(own)] - own[min(own)])


def test_days_are_filled_after_one_shuffle(spark, sparse):
    plan = filled_days(sparse, "area", "day", ["v"], "spread")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_no_days(spark, sparse):
    assert filled_days(sparse.filter("v < 0"), "area", "day", ["v"], "carry").count() == 0


def test_falls_are_carried_on(spark):
    data = [("a", 1, 10, 1), ("a", 2, 15, None), ("a", 3, 0, 0), ("a", 4, 4, 5), ("a", 5, 3, None), ("a", 6, None, 4), ("b", 1, 7, 2), ("b", 2, 7, 1)]
    df = spark.createDataFrame(data, "area string, day int, v long, w int")
    found = carried_resets(df, "area", "day", ["v", "w"])
    assert of(found, "a", "v", "w") == [(10, 1), (15, None), (15, 1), (19, 6), (19, None), (None, 6)]
    assert of(found, "b", "v", "w") == [(7, 2), (7, 2)]
    assert rows(reset_events(found, "area", "day", ["v", "w"])) == [
        ("a", 3, "v", 15), ("a", 3, "w", 1), ("a", 5, "v", 1), ("a", 6, "w", 1), ("b", 2, "w", 1),
    ]


def test_days_with_both(spark):
    raw = reports(spark, ("US", "2021-01-01", 10, 8), ("US", "2021-01-02", 4, 0), ("US", "2021-01-05", 10, None))
    found = area_day_table(raw, gaps="spread", resets="carry").orderBy("date")
    assert [tuple(r) for r in found.select("Confirmed_cumulative", "Confirmed_daily_new", "Recovered_cumulative", "reported").collect()] == [
        (10, None, 8, True), (10, 0, 8, True), (12, 2, 8, False), (14, 2, 8, False), (16, 2, 8, True),
    ]
    with pytest.raises(ValueError):
        area_day_table(raw, gaps="none")


def test_a_run_lists_the_falls(spark, inputs, tmp_path):  # noqa: F811
    paths = run_batch(spark, inputs, str(tmp_path / "out"), gaps="carry", resets="carry")
    lines = dataset(spark, paths["quality"], QUALITY).filter("section = 'reset'")
    # Each report has 7 of these, and two of them are from one day.
    assert ("2021-01-03 US Active_cumulative", 7.0) in rows(lines.select("metric", "value"))
    assert lines.filter("metric LIKE '%Confirmed%'").count() == 0
    cases = dataset(spark, paths["cases"], CASES).filter("Country_Region = 'US' AND year_month = '2021-01'")
    assert rows(cases.select("Confirmed_cumulative", "Confirmed_monthly_new")) == [(150, 60)]


MONTHS = [f"{2019 + m // 12}-{m % 12 + 1:02d}" for m in range(30)]


@pytest.fixture(scope="module")
def series(spark):
    """Keys with missing months, values that are NULL or negative, several rows a month."""
    rng = random.Random(2)
    data = [(f"k{k}", m, rng.choice([None, rng.randrange(-100, 100), rng.randrange(1000)])) for k in range(6) for m in MONTHS for _ in range(rng.randrange(3)) if k or "2019-09" < m < "2020-02"]
    data += [(None, MONTHS[3], 5), ("k1", None, 5), ("none", MONTHS[7], None)]
    return spark.createDataFrame(data, "key string, month string, v long").cache()


def test_every_range_of_sums_and_peaks(spark, series):
    index = range_index(series, ["key"], "v")
    known = series.filter("key IS NOT NULL AND month IS NOT NULL")
    ranges = index.all_ranges()
    assert ranges.count() == 30 * 31 // 2
    direct = known.join(ranges, F.col("month").between(F.col("range_start"), F.col("range_end"))).groupBy("range_start", "range_end", "key")
    assert rows(index.totals(ranges), "range_start", "range_end", "key", "v") == rows(direct.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")))
    assert rows(index.peaks(ranges), "range_start", "range_end", "key", "v") == rows(direct.agg(F.max("v").alias("v")))


def test_ranges_beyond_the_index(spark, series):
    index = range_index(series, ["key"], "v")
    asked = spark.createDataFrame([("2000-01", "2019-06"), ("2021-03", "2030-01"), ("2020-05", "2020-04"), ("1999-01", "1999-02")], "range_start string, range_end string")
    want = [total_in_range(series, "key", "v", s, e).select(F.lit(s).alias("s"), F.lit(e).alias("e"), "key", "v") for s, e in (("2000-01", "2019-06"), ("2021-03", "2030-01"))]
    assert rows(index.totals(asked)) == rows(want[0].unionByName(want[1]))
    want = [peak_in_range(series, "key", "v", s, e).select(F.lit(s).alias("s"), F.lit(e).alias("e"), "key", "v") for s, e in (("2000-01", "2019-06"), ("2021-03", "2030-01"))]
    assert rows(index.peaks(asked)) == rows(want[0].unionByName(want[1]))


def test_lookups_read_the_index_alone(spark, series):
    index = range_index(series, ["key"], "v")
    plan = index.totals(index.all_ranges())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "InMemoryRelation" not in plan and "range-index" in str(index.rows.inputFiles())


def test_an_index_of_nothing(spark, series):
    asked = spark.createDataFrame([("2000-01", "2030-01")], "range_start string, range_end string")
    none = series.filter("key = 'x'")
    index = range_index(none, ["key"], "v")
    assert index.totals(asked).count() == index.peaks(asked).count() == index.all_ranges().count() == 0
    pairs = none.withColumn("w", F.col("v"))
    assert correlation_index(pairs, "v", "w", ["key"]).correlations(asked).count() == 0


@pytest.mark.parametrize("offset", [0, 10**12])
def test_every_range_of_correlations(spark, offset):
    rng = random.Random(3)
    data = []
    for k in range(4):
        for m in MONTHS:
            for _ in range(rng.randrange(3)):
                x = rng.random()
                data.append((f"k{k}", m, rng.choice([None, offset + x]), offset + 0.5 * x + rng.random()))
    data += [("flat", m, 1.0, float(i)) for i, m in enumerate(MONTHS)]
    df = spark.createDataFrame(data, "key string, month string, x double, y double")
    index = correlation_index(df, "x", "y", ["key"])
    ranges = range_index(df, ["key"], "x").all_ranges()
    found = {tuple(r)[:3]: r["r"] for r in index.correlations(ranges).collect()}
    assert not any(v is not None for (_, _, k), v in found.items() if k == "flat")
    assert len({k[:2] for k in found if k[2] == "flat"}) == 30 * 31 // 2
    for (s, e, key), r in found.items():
        # Around one of the values, so that nothing is lost to the offset here.
        pairs = [(x - offset, y - offset) for k, m, x, y in data if k == key and s <= m <= e and x is not None]
        n, mx, my = len(pairs), sum(x for x, _ in pairs) / len(pairs), sum(y for _, y in pairs) / len(pairs)
        sx, sy = sum((x - mx) ** 2 for x, _ in pairs), sum((y - my) ** 2 for _, y in pairs)
        if n < 2 or sx == 0 or sy == 0:
            assert r is None
        else:
            want = sum((x - mx) * (y - my) for x, y in pairs) / math.sqrt(sx * sy)
            assert r == pytest.approx(want, abs=5e-7 if not offset else 2e-3)


def test_co_moments_keep_what_plain_sums_lose(spark):
    """Whole numbers near 1e12, which doubles hold exactly."""
    rng = random.Random(9)
    data = [("k", m, 10**12 + rng.randrange(50), 10**12 + rng.randrange(50)) for m in MONTHS for _ in range(3)]
    df = spark.createDataFrame(data, "key string, month string, x long, y long")
    got = {tuple(r)[:2]: r["r"] for r in correlation_index(df, "x", "y", ["key"]).correlations(range_index(df, ["key"], "x").all_ranges()).collect()}
    small = df.selectExpr("key", "month", "x - 1000000000000 AS x", "y - 1000000000000 AS y")
    for s, e in (("2019-01", "2021-06"), ("2019-04", "2019-04"), ("2019-12", "2020-05"), ("2021-01", "2021-06")):
        want = correlation(small.filter(F.col("month").between(s, e)), "x", "y").first()["r"]
        assert got[s, e] == pytest.approx(want, abs=1e-6)


def test_totals_of_a_run_may_fall(spark):
    raw = reports(spark, ("US", "2021-01-01", 10, 8), ("US", "2021-01-02", 4, 9))
    from tallyflow.plans.quality_report import reset_lines
    from tallyflow.schemas import SnapshotSpec

    lines = reset_lines(area_day_totals(raw, SnapshotSpec()), SnapshotSpec())
    assert ("reset", "2021-01-02 US Confirmed_cumulative", 6.0) in rows(lines)
