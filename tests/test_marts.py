from __future__ import annotations

import datetime as dt

import pytest

from tallyflow.functions.calendar import month_of_number
from tallyflow.functions.text import areas_label
from tallyflow.operators.filters import months_between, renamed_areas
from tallyflow.operators.reshape import long_days, long_stats, union_by_name
from tallyflow.operators.rollups import (
    area_month_series,
    correlation,
    default_range,
    month_domain,
    recombined,
)
from tallyflow.plans.marts import (
    cases_with_flows,
    destination_flows,
    marts_from_csv,
    monthly_cases,
    pair_flows,
    series_marts,
)
from tallyflow.plans.views import map_views, stat_correlation, time_series
from tallyflow.schemas import SnapshotSpec
from tallyflow.sources.readers import read_wide_series
from tests.conftest import rows
from pyspark.sql import functions as F

SPEC = SnapshotSpec()
CASES = "year_month string, Country_Region string, " + ", ".join(
    f"{c} long" for c in SPEC.cumulative
)

# Published cumulative counts of one country in two batches
# that overlap in four months.
FIRST_BATCH = """
2020-03 188218 3896 7024 184831
2020-04 1040757 61866 120720 979773
2020-05 1765285 104034 416461 1668533
2020-06 2777935 148029 705203 2627502
2020-07 4493374 152039 1414155 4355662
2020-08 6028681 182288 2153939 5825889
2020-09 7227888 204959 2813305 7010355
2020-10 9116553 229251 3578452 8876471
2020-11 13508955 269186 5065030 13262451
2020-12 19902689 347360 6399531 19556246
2021-01 20216522 350578 0 19810953
2021-04 30846 214 0 30632
"""
SECOND_BATCH = """
2020-08 55480 1095 0.0 9685.0
2020-12 74580 256 0.0 52159.0
2021-01 26243105 444661 0.0 25755319.0
2021-02 28711052 510730 0.0 28155068.0
2021-03 30509372 547269 0.0 28568199.0
2021-04 32410180 571353 0.0 42513.0
2021-05 33379941 590076 - -
2021-06 35909045 632648 - -
2021-07 35062519 609300 - -
2021-08 39214860 636320 - -
2021-09 43429302 694062 - -
2021-10 46018752 744623 - -
2021-11 48488159 777786 - -
2021-12 54390968 824695 - -
2022-01 54903011 825426 - -
"""
# Month, the four sums and their four changes; a dash stands for NULL.
RECOMBINED = """
2020-03 188218 3896 7024 184831 - - - -
2020-04 1040757 61866 120720 979773 852539 57970 113696 794942
2020-05 1765285 104034 416461 1668533 724528 42168 295741 688760
2020-06 2777935 148029 705203 2627502 1012650 43995 288742 958969
2020-07 4493374 152039 1414155 4355662 1715439 4010 708952 1728160
2020-08 6084161 183383 2153939 5835574 1590787 31344 739784 1479912
2020-09 7227888 204959 2813305 7010355 1143727 21576 659366 1174781
2020-10 9116553 229251 3578452 8876471 1888665 24292 765147 1866116
2020-11 13508955 269186 5065030 13262451 4392402 39935 1486578 4385980
2020-12 19977269 347616 6399531 19608405 6468314 78430 1334501 6345954
2021-01 46459627 795239 0 45566272 26482358 447623 -6399531 25957867
2021-02 28711052 510730 0 28155068 -17748575 -284509 0 -17411204
2021-03 30509372 547269 0 28568199 1798320 36539 0 413131
2021-04 32441026 571567 0 73145 1931654 24298 0 -28495054
2021-05 33379941 590076 0 0 938915 18509 0 -73145
2021-06 35909045 632648 0 0 2529104 42572 0 0
2021-07 35062519 609300 0 0 -846526 -23348 0 0
2021-08 39214860 636320 0 0 4152341 27020 0 0
2021-09 43429302 694062 0 0 4214442 57742 0 0
2021-10 46018752 744623 0 0 2589450 50561 0 0
2021-11 48488159 777786 0 0 2469407 33163 0 0
2021-12 54390968 824695 0 0 5902809 46909 0 0
2022-01 54903011 825426 0 0 512043 731 0 0
"""
# End of the fixed values.


def month_lines(text: str) -> list[str]:
    """CSV lines as a batch writes them, with no monthly change filled in."""
    header = ",".join(["year_month", "Country_Region", *SPEC.month_stats])
    lines = [header]
    for line in text.strip().splitlines():
        month, *values = line.split()
        cells = ["" if v == "-" else v for v in values]
        lines.append(",".join([month, "US", *cells, *[""] * 4]))
    return lines


FLOW_HEADER = (
    "year_month,origin_country,origin_country_code,destination_country,"
    "destination_country_code,flight_count"
)


@pytest.fixture
def marts(spark, write, tmp_path):
    write("covid_2020_US.csv", *month_lines(FIRST_BATCH))
    write("covid_2021_US.csv", *month_lines(SECOND_BATCH))
    write("covid_2020_all.csv", *month_lines(FIRST_BATCH))
    write(
        "flight_2020_US.csv",
        FLOW_HEADER,
        "2020-03,France,FR,United States,US,5",
        "2020-03,Namibia,NA,United States,US,",
        "2020-03,France,FR,Canada,CA,70",
        "2020-04,France,FR,United States,US,4",
    )
    write("flight_2021_US.csv", FLOW_HEADER, "2020-04,France,FR,United States,US,3")
    return marts_from_csv(
        spark,
        f"{tmp_path}/covid_*_all.csv",
        f"{tmp_path}/covid_*_US.csv",
        f"{tmp_path}/flight_*_US.csv",
    )


def test_golden_recombination(marts):
    columns = ["month", *SPEC.month_stats]
    expected = [
        (month, *[None if v == "-" else int(v) for v in values])
        for month, *values in (line.split() for line in RECOMBINED.strip().splitlines())
    ]
    assert rows(marts["focus_with_flows"], *columns) == expected


def test_marts(marts):
    assert rows(marts["pair_flows"], "month", "end_country", "origin_country", "flight_count") == [
        ("2020-03", "Canada", "France", 70),
        ("2020-03", "United States", "France", 5),
        ("2020-03", "United States", "Namibia", 0),
        ("2020-04", "United States", "France", 7),
    ]
    assert rows(marts["destination_flows"]) == [
        ("2020-03", "Canada", 70),
        ("2020-03", "United States", 5),
        ("2020-04", "United States", 7),
    ]
    joined = marts["focus_with_flows"]
    assert joined.count() == 23
    assert rows(joined.filter("flight_count IS NOT NULL"), "month", "country", "flight_count") == [
        ("2020-03", "US", 5),
        ("2020-04", "US", 7),
    ]
    assert marts["cases_long"].count() == 12 * 8
    assert marts["focus_cases_long"].count() == 23 * 8
    assert marts["focus_cases_long"].columns == ["country", "month", "stat", "value"]


def test_marts_make_views(marts):
    view = map_views(marts["pair_flows"], marts["cases_long"], "2020-03", "2020-03")
    assert rows(view["flows"]) == [("France", 75), ("Namibia", 0)]
    assert rows(view["peaks"]) == [("US", None)]
    # The scales cover all months.
    assert rows(view["scales"]) == [(82, 6393734)]
    series = time_series(marts["focus_with_flows"], "Deaths_cumulative", "2020-03", "2020-04")
    assert rows(series) == [
        ("2020-03", "Deaths Cumulative", 3896, 5),
        ("2020-04", "Deaths Cumulative", 61866, 7),
    ]
    r = stat_correlation(marts["focus_with_flows"], "Deaths_cumulative", "2020-03", "2022-01")
    assert rows(r.select(F.round("r", 6), "shown")) == [(1.0, 1.0)]
    with pytest.raises(ValueError):
        time_series(marts["focus_with_flows"], "country", "2020-03", "2020-04")


def test_all_null_sum_is_zero_and_null_keys_are_left_out(spark):
    df = spark.createDataFrame(
        [("2021-02", "US", None), ("2021-03", None, 4), (None, "US", 5)],
        "m string, a string, v long",
    )
    assert rows(recombined(df, ["m", "a"], ["v"])) == [("2021-02", "US", 0)]


def test_overlap_is_summed_or_the_larger_one_taken(spark):
    df = spark.createDataFrame([("2021-01", "US", 5), ("2021-01", "US", 7)], "m string, a string, v long")
    assert rows(recombined(df, ["m", "a"], ["v"])) == [("2021-01", "US", 12)]
    assert rows(recombined(df, ["m", "a"], ["v"], "max")) == [("2021-01", "US", 7)]
    with pytest.raises(ValueError):
        recombined(df, ["m", "a"], ["v"], "mean")


def test_monthly_change_is_taken_within_a_country(spark):
    df = spark.createDataFrame(
        [
            ("2021-01", "FR", 10, 0, 0, 0),
            ("2021-02", "FR", 14, 0, 0, 0),
            ("2021-01", "US", 100, 0, 0, 0),
            ("2021-02", "US", 150, 0, 0, 0),
        ],
        CASES,
    )
    got = rows(monthly_cases(df), "country", "month", "Confirmed_monthly_new")
    assert got == [
        ("FR", "2021-01", None),
        ("FR", "2021-02", 4),
        ("US", "2021-01", None),
        ("US", "2021-02", 50),
    ]


def test_join_of_two_destinations_gives_one_row_per_month(spark):
    cases = spark.createDataFrame([("2021-01", "US", 1), ("2021-01", "FR", 2)], "month string, country string, v int")
    flows = spark.createDataFrame(
        [("2021-01", "United States", 5), ("2021-01", "France", 6)],
        "month string, end_country string, flight_count long",
    )
    assert rows(cases_with_flows(cases, flows, "US")) == [("2021-01", "US", 1, 5)]
    every = cases_with_flows(cases, flows)
    assert rows(every, "country", "flight_count") == [("FR", None), ("US", 5)]
    named = cases_with_flows(cases, flows, "FR", destination="France")
    assert rows(named, "country", "flight_count") == [("FR", 6)]


def test_namibia_is_kept(spark):
    df = spark.createDataFrame(
        [("2021-01", "Namibia", "NA", "United States", "US", 2), ("2021-01", None, None, "United States", "US", 9)],
        "year_month string, origin_country string, origin_country_code string, "
        "destination_country string, destination_country_code string, flight_count long",
    )
    pairs = pair_flows(df)
    assert rows(pairs, "origin_country_code", "flight_count") == [("NA", 2)]
    assert rows(destination_flows(pairs)) == [("2021-01", "United States", 2)]


def test_unpivot_keeps_nulls(spark):
    df = spark.createDataFrame(
        [("US", "2021-01", 1, 2, 3, 4, 5, 6, 7, None)],
        "country string, month string, " + ", ".join(f"{c} long" for c in SPEC.month_stats),
    )
    long = long_stats(df, ["country", "month"], SPEC.month_stats)
    assert long.count() == 8
    assert rows(long.filter("value IS NULL"), "stat") == [("Active_monthly_new",)]


def test_wide_series(spark, write):
    path = write(
        "series.csv",
        "Province/State,Country/Region,Lat,Long,1/30/21,1/31/21,2/1/21",
        ",US,1,2,1,3,6",
        "North,CA,1,2,1,2,10",
        "South,CA,1,2,1.0,5,",
    )
    wide = read_wide_series(spark, path)
    days = long_days(wide, dropped=["Province/State", "Lat", "Long"])
    assert days.count() == 9
    assert rows(days.filter("`Country/Region` = 'US'"), "Date", "Confirmed") == [
        (dt.date(2021, 1, 30), 1),
        (dt.date(2021, 1, 31), 3),
        (dt.date(2021, 2, 1), 6),
    ]
    sums = area_month_series(days, "Country/Region", "Date", "Confirmed")
    assert rows(sums) == [("CA", "2021-01", 9), ("CA", "2021-02", 10), ("US", "2021-01", 4), ("US", "2021-02", 6)]
    peaks = area_month_series(days, "Country/Region", "Date", "Confirmed", how="max")
    assert rows(peaks)[0] == ("CA", "2021-01", 7)

    flows = spark.createDataFrame(
        [(202101, "US", 8), (202101, "CA", 9)], "month int, end_country string, flights long"
    )
    tables = series_marts(wide, flows)
    assert rows(tables["focus_with_flows"], "month", "country", "cases", "flights") == [
        ("2021-01", "US", 4, 8),
        ("2021-02", "US", 6, None),
    ]
    assert rows(tables["destination_flows"], "month") == [("2021-01",), ("2021-01",)]


def test_month_bucket_sums_a_cumulative_series_or_takes_its_peak(spark):
    df = spark.createDataFrame(
        [("US", dt.date(2021, 1, d), v) for d, v in ((1, 1), (2, 3), (3, 6))], "a string, d date, v long"
    )
    assert rows(area_month_series(df, "a", "d", "v"), "v") == [(10,)]
    assert rows(area_month_series(df, "a", "d", "v", how="max"), "v") == [(6,)]


def test_two_digit_years(spark):
    wide = spark.createDataFrame([("A", "1", "2", "3")], "area string, `12/31/68` string, `1/1/69` string, `2/29/96` string")
    days = long_days(wide, area="area", value="v", day="d")
    assert [d for d, _ in rows(days, "d", "v")] == [
        dt.date(1969, 1, 1),
        dt.date(1996, 2, 29),
        dt.date(2068, 12, 31),
    ]


def test_month_of_number(spark):
    df = spark.createDataFrame([(202101,), (202113,), (2021,), (None,)], "n int")
    assert [r[0] for r in df.select(month_of_number(F.col("n"))).collect()] == ["2021-01", None, None, None]


def test_correlation_never_fails(spark):
    data = {
        "a": [(1, 2)],
        "b": [(1, 2), (2, None)],
        "c": [(1, 5), (1, 6)],
        "d": [(None, 1)],
        "e": [(1, 2), (2, 4), (3, None)],
    }
    df = spark.createDataFrame(
        [(k, x, y) for k, pairs in data.items() for x, y in pairs], "k string, x int, y int"
    )
    got = correlation(df, "x", "y", by=["k"]).withColumn("r", F.round("r", 6))
    assert rows(got) == [("a", None), ("b", None), ("c", None), ("d", None), ("e", 1.0)]
    assert rows(correlation(df.limit(0), "x", "y")) == [(None,)]


@pytest.mark.parametrize(
    ("months", "end"),
    [(["2020-08", "2020-03", "2021-01", "2020-03"], "2020-08"), (["2020-03", "2020-05"], "2020-05")],
)
def test_default_range_and_domain(spark, months, end):
    df = spark.createDataFrame([(m,) for m in months], "month string")
    assert rows(default_range(df, "2020-08")) == [("2020-03", end)]
    assert rows(default_range(df)) == [(min(months), max(months))]
    assert [r[0] for r in month_domain(df).collect()] == sorted(set(months))


def test_months_between_includes_both_ends(spark):
    df = spark.createDataFrame([(f"2020-{m:02d}",) for m in range(1, 13)], "month string")
    assert rows(months_between(df, "2020-09", "2020-11")) == [("2020-09",), ("2020-10",), ("2020-11",)]


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2, True)], "s string, n int, extra boolean")
    assert rows(union_by_name([a, b])) == [(1, "x", None), (2, "y", True)]


def test_aliases_and_labels(spark):
    df = spark.createDataFrame([("US",), ("France",), (None,)], "n string")
    renamed = df.select(renamed_areas(F.col("n"), {"US": "United States"}).alias("n"))
    assert [r[0] for r in renamed.collect()] == ["United States", "France", None]
    assert rows(df.select(renamed_areas(F.col("n"), {}))) == rows(df)
    assert areas_label(None) == areas_label([]) == "all"
    assert areas_label(["b", "a"]) == areas_label(["a", "b", "a"]) == "a,b"
    lists = [["a b"], ["a_b"], ["x__y"], ["x", "y"], ["x,y"], ["all"], ["*"], ["a", "b"], [], ["x%2Cy"]]
    assert len({areas_label(names) for names in lists}) == len(lists)
