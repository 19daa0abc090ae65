from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.lookups import attach, place_table, repeated_keys, unique_by, unmatched
from tallyflow.plans.flows import (
    count_flows,
    country_pair_counts,
    flow_order,
    map_flows,
    pair_counts,
    spread_rows,
)
from tallyflow.operators.quality import null_profile
from tallyflow.plans.quality_report import unmatched_names
from tests.conftest import rows

FLOW = "day string, origin string, destination string"


@pytest.fixture
def facilities(spark):
    return spark.createDataFrame(
        [
            ("KJFK", "US"),
            ("KJFK", "US"),
            ("KLAX", "US"),
            ("LFPG", "FR"),
            ("FYWH", "NA"),
            ("XXXX", "??"),
            ("ZZZZ", None),
        ],
        "icao string, country string",
    )


@pytest.fixture
def codes(spark):
    return spark.createDataFrame(
        [("US", "United States"), ("FR", "France"), ("NA", "Namibia"), ("NA", "Namibia")],
        "country_code string, country string",
    )


@pytest.fixture
def flows(spark):
    return spark.createDataFrame(
        [
            ("2021-01-01 00:00:00+00:00", "KJFK", "LFPG"),
            ("2021-01-01 00:00:00+00:00", "KJFK", "LFPG"),
            ("2021-01-02 00:00:00+00:00", "KLAX", "LFPG"),
            ("2021-01-02 00:00:00+00:00", "KLAX", "KJFK"),
            ("2021-02-01 00:00:00+00:00", "FYWH", "LFPG"),
            ("2021-02-01 00:00:00+00:00", None, "LFPG"),
            ("2021-02-01 00:00:00+00:00", "QQQQ", "LFPG"),
            ("2021-02-01 00:00:00+00:00", "XXXX", "LFPG"),
            ("2021-02-01 00:00:00+00:00", "ZZZZ", "LFPG"),
            (None, "KJFK", "LFPG"),
        ],
        FLOW,
    )


SHORT = ["year_month", "origin_country_code", "destination_country_code", "flight_count"]
EXPECTED = [("2021-01", "US", "FR", 3), ("2021-02", "NA", "FR", 1)]


def test_international_flows_with_known_ends_are_counted(flows, facilities, codes):
    mapped = map_flows(flows, place_table(facilities, codes))
    counts = count_flows(mapped, "origin", "year_month")
    assert rows(counts, *SHORT) == EXPECTED
    assert rows(counts, "origin_country") == [("Namibia",), ("United States",)]
    # The domestic flow is mapped, but not counted.
    assert mapped.count() == 5


@pytest.mark.parametrize(
    ("direction", "granular", "countries"),
    [
        ("origin", "day", None),
        ("origin", "year_month", ["United States"]),
        ("destination", "day", ["France", "Namibia"]),
        ("destination", "year_month", []),
    ],
)
def test_all_plans_agree(flows, facilities, codes, granular, direction, countries):
    places = place_table(facilities, codes)
    options = (direction, granular, countries)
    expected = count_flows(map_flows(flows, places), *options)
    columns = expected.columns
    for got in (
        count_flows(map_flows(pair_counts(flows), places), *options),
        count_flows(map_flows(flows, places, spread=4), *options),
        country_pair_counts(flows, facilities, codes, *options),
        country_pair_counts(pair_counts(flows), facilities, codes, *options),
    ):
        assert got.columns == columns
        assert rows(got) == rows(expected)


def test_arguments_are_checked(flows, facilities, codes):
    mapped = map_flows(flows, place_table(facilities, codes))
    with pytest.raises(ValueError):
        count_flows(mapped, "sideways")
    with pytest.raises(ValueError):
        count_flows(mapped, "origin", "year")
    with pytest.raises(ValueError):
        country_pair_counts(flows, facilities, codes, "origin", "week")
    assert flow_order("destination", "day") == [
        "destination_country_code",
        "origin_country_code",
        "day",
    ]


def test_profile_of_incomplete_flows(flows, facilities, codes):
    places = place_table(facilities, codes)
    expected = {
        "day": 1,
        "origin_icao": 2,
        "origin_country_code": 3,
        "origin_country": 4,
        "destination_icao": 0,
        "destination_country_code": 0,
        "destination_country": 0,
        "year_month": 1,
    }
    every = map_flows(flows, places, keep_incomplete=True)
    assert null_profile(every).first().asDict() == expected
    pairs = map_flows(pair_counts(flows), places, keep_incomplete=True)
    assert null_profile(pairs, "flights").first().asDict() == expected


def test_repeated_facility_counts_each_flow_once(facilities):
    assert rows(repeated_keys(facilities, "icao")) == [("KJFK", 2)]
    assert unique_by(facilities, "icao", "country").count() == 6


def test_totals_by_origin_equal_totals_by_pair(flows, facilities, codes):
    counts = country_pair_counts(flows, facilities, codes, "origin", "day")
    by_origin = counts.groupBy("origin_country").agg(F.sum("flight_count").alias("n"))
    assert sum(n for _, n in rows(by_origin)) == sum(n for (n,) in rows(counts, "flight_count"))


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_busy_facility_with_a_third_of_all_flows(spark, conf, broadcast):
    """Broadcast or sort merge, salted or not, the counts are the same."""
    flows = spark.range(60000).select(
        F.date_add(F.lit("2021-01-01"), (F.col("id") % 40).cast("int")).alias("day"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("origin"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 90).alias("destination"),
    )
    facilities = spark.range(450).select(
        F.col("id").alias("icao"), (F.col("id") % 9).alias("country")
    )
    codes = spark.range(8).select(
        F.col("id").alias("country_code"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("country")
    )
    pdf = flows.toPandas()
    known = pdf[pdf.origin.notna() & pdf.destination.notna() & (pdf.origin < 450)]
    ends = known.assign(o=known.origin % 9, d=known.destination % 9)
    ends = ends[(ends.o < 8) & (ends.d < 8) & (ends.o != ends.d)]
    expected = sorted(ends.groupby(["o", "d"]).size().items())
    with conf(spark__sql__autoBroadcastJoinThreshold=broadcast):
        places = place_table(facilities, codes)
        for counts in (
            country_pair_counts(flows, facilities, codes),
            count_flows(map_flows(flows, places)),
            count_flows(map_flows(flows, places, spread=8)),
            country_pair_counts(pair_counts(flows), facilities, codes),
        ):
            got = counts.groupBy("origin_country_code", "destination_country_code").agg(
                F.sum("flight_count").alias("n")
            )
            assert sorted(((o, d), n) for o, d, n in rows(got)) == [
                ((int(o), int(d)), n) for (o, d), n in expected
            ]


def test_flows_without_a_facility_never_reach_the_shuffle(spark, flows, facilities, codes, conf):
    with conf(spark__sql__autoBroadcastJoinThreshold="-1"):
        counts = country_pair_counts(flows, facilities, codes)
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in plan
        assert "isnotnull(origin" in plan and "isnotnull(destination" in plan


def test_attach_keeps_every_fact_and_salts_by_content(spark):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (9, "d")], "k int, v string")
    dimension = spark.createDataFrame([(1, "one"), (2, "two")], "id int, name string")
    expected = [(1, "a", "one"), (1, "b", "one"), (9, "d", None), (None, "c", None)]
    for spread in (1, 5):
        got = attach(facts, "k", dimension, "id", {"name": "label"}, spread)
        assert got.columns == ["k", "v", "label"]
        assert rows(got) == expected


def test_a_salted_lookup_broadcasts_no_copies(spark):
    facts = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    dimension = spark.range(10).selectExpr("id", "'x' AS name")
    got = attach(facts, "k", dimension, "id", {"name": "label"}, 8)
    assert got.filter("label = 'x'").count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_flows_are_spread_as_dates_without_a_sort(spark):
    raw = [("2021-01-02 00:00:00+00:00", "A", "B"), ("2021-01-02 00:00:00+00:00", "A", "B"), ("x", None, "B"), (None, None, None)]
    got = spread_rows(spark.createDataFrame(raw, "day string, origin string, destination string"))
    assert dict(got.dtypes)["day"] == "date"
    assert "RoundRobin" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == sorted([(dt.date(2021, 1, 2), "A", "B")] * 2 + [(None, None, "B"), (None, None, None)], key=lambda r: tuple(map(str, r)))


def test_unmatched_names(spark):
    cases = spark.createDataFrame([("US",), ("Atlantis",), ("Atlantis",), (None,)], "n string")
    known = spark.createDataFrame([("US",), ("FR",)], "c string")
    assert rows(unmatched(cases, "n", known, "c")) == [("Atlantis",)]
    assert rows(unmatched_names(cases, "n", known, "c")) == [
        ("names", "unmatched_names", 1.0),
        ("unmatched_name", "Atlantis", 1.0),
    ]


def test_aqe_splits_a_busy_facility(spark, conf):
    """Facilities too large to broadcast, codes small enough."""
    flows = spark.range(200000).select(
        F.lit("2021-01-01").cast("date").alias("day"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("origin"),
        (F.col("id") % 4999).alias("destination"),
    )
    facilities = spark.range(5000).select(
        F.col("id").alias("icao"), (F.col("id") % 9).alias("country")
    )
    codes = spark.range(9).select(
        F.col("id").alias("country_code"), F.col("id").cast("string").alias("country")
    )
    with conf(
        spark__sql__autoBroadcastJoinThreshold="16k",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
    ):
        for counts in (
            country_pair_counts(flows, facilities, codes),
            count_flows(map_flows(flows, place_table(facilities, codes))),
        ):
            assert counts.agg(F.sum("flight_count")).first()[0] > 100000
            counts.collect()
            plan = counts._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan
