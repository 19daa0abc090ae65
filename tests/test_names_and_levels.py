"""Candidates for unknown names, alias tables in the marts, levels of flow counts, and reruns that fail."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.matching import grams, name_candidates, plain_name, recall
from tallyflow.plans.marts import LEVELS, cases_with_flows, destination_flows, flow_hierarchy, marts_from_csv, with_known_names
from tallyflow.plans.quality_report import unmatched_names
from tallyflow.session import aside_of
from tallyflow.sources.sinks import partition_path, write_batch
from tests.conftest import rows

NAMES = [
    "United States", "Korea, Republic of", "Taiwan, Province of China", "Iran, Islamic Republic of", "Russian Federation",
    "Viet Nam", "Côte d'Ivoire", "Bosnia and Herzegovina", "Trinidad and Tobago", "Antigua and Barbuda", "Czech Republic",
    "Dominican Republic", "Dominica", "Niger", "Nigeria", "Guinea", "Guinea-Bissau", "Equatorial Guinea", "Papua New Guinea",
    "Saint Lucia", "Saint Vincent and the Grenadines", "Saint Kitts and Nevis", "Netherlands", "New Zealand", "Switzerland",
    "Swaziland", "Slovakia", "Slovenia", "Australia", "Austria", "Mauritius", "Mauritania", "Mali", "Malawi", "Malaysia",
    "Malta", "Maldives", "Azerbaijan", "Kazakhstan", "Kyrgyzstan", "Uzbekistan", "Turkmenistan", "Tajikistan", "Liechtenstein",
]


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def typo(rng, name):
    at = rng.randrange(1, len(name) - 1)
    kind = rng.randrange(4)
    if kind == 0:
        return name[:at] + name[at + 1 :]
    if kind == 1:
        return name[:at] + rng.choice("abcdefgh") + name[at:]
    if kind == 2:
        return name[: at - 1] + name[at] + name[at - 1] + name[at + 1 :]
    return name.upper().replace(",", "")


def test_planted_typos_are_found(spark):
    rng = random.Random(1)
    truth = {typo(rng, n): n for n in NAMES for _ in range(5)}
    truth = {wrong: n for wrong, n in truth.items() if wrong not in NAMES}
    found = name_candidates(frame(spark, truth), "name", frame(spark, NAMES), "name")
    right = spark.createDataFrame(list(truth.items()), "name string, candidate string")
    assert recall(found, right, ["name", "candidate"]).first()["recall"] >= 0.9
    assert found.filter("score <= 0 OR score > 1 OR rank > 1").count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_no_pair_within_the_bound_is_missed(spark):
    """Against all pairs, over names of few letters, where grams are frequent and repeat."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
    known, names = {word() for _ in range(60)}, {word() for _ in range(60)}
    found = name_candidates(frame(spark, names), "name", frame(spark, known), "name", best=1000)
    want = []
    for a in names:
        for b in known:
            d, longer = edits(a, b), max(len(a), len(b))
            if d < longer and d <= max(longer // 4, min(longer // 2, 2), 1):
                want.append((a, b, pytest.approx(1 - d / longer)))
    got = rows(found, "name", "candidate", "score")
    assert [r[:2] for r in got] == sorted(w[:2] for w in want) and all(g[2] == w[2] for g, w in zip(got, sorted(want, key=lambda w: w[:2])))


def test_words_in_another_order_are_one_name(spark):
    got = frame(spark, ["Korea, Republic of", "Republic  of KOREA", "Île-de-X 2", "...", ""]).select(plain_name(F.col("name")))
    assert [r[0] for r in got.collect()] == ["korea of republic", "korea of republic", "2 de x île", "", ""]
    assert frame(spark, ["aaa"]).select(grams(F.col("name"))).first()[0] == ["^a0", "aa0", "aa1", "a$0"]


def test_names_without_letters_or_candidates(spark):
    found = name_candidates(frame(spark, [None, "", "--", "Zzzzzz"]), "name", frame(spark, [None, "", *NAMES]), "name")
    assert found.count() == 0
    assert name_candidates(frame(spark, []), "name", frame(spark, NAMES), "name").count() == 0


def test_there_is_no_table_of_all_pairs(spark):
    plan = name_candidates(frame(spark, NAMES), "name", frame(spark, NAMES), "name")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_report_names_the_likeliest(spark):
    lines = unmatched_names(frame(spark, ["Untied States", "Mali", "Atlantis"]), "name", frame(spark, NAMES), "name")
    assert rows(lines, "section", "metric") == [
        ("name_candidate", "Untied States is United States"),
        ("names", "unmatched_names"),
        ("unmatched_name", "Atlantis"),
        ("unmatched_name", "Untied States"),
    ]


CASES = "month string, country string, Confirmed_cumulative long"
FLOWS = "month string, end_country string, flight_count long"


def test_aliases_of_a_table_or_a_mapping(spark):
    cases = spark.createDataFrame([("2020-01", "US", 1), ("2020-01", "Korea", 2), ("2020-01", "France", 3), ("2020-02", None, 4)], CASES)
    flows = spark.createDataFrame([("2020-01", "United States", 10), ("2020-01", "Korea, Republic of", 20), ("2020-01", "France", 30)], FLOWS)
    pairs = {"US": "United States", "Korea": "Korea, Republic of"}
    table = spark.createDataFrame([*pairs.items(), ("Korea", "South Korea"), (None, "x")], "area string, known_as string")
    want = [("France", 30), ("Korea", 20), ("None", None), ("US", 10)]
    for aliases in (pairs, table):
        joined = cases_with_flows(cases, flows, aliases=aliases)
        assert [(str(r[0]), r[1]) for r in rows(joined, "country", "flight_count")] == want
        assert rows(cases_with_flows(cases, flows, "Korea", aliases=aliases), "country", "flight_count") == [("Korea", 20)]
        assert rows(cases_with_flows(cases, flows, "France", aliases=aliases), "country", "flight_count") == [("France", 30)]
    assert [r[0] for r in rows(with_known_names(cases, "country", table, "k"), "k")] == ["France", "Korea, Republic of", None, "United States"]
    assert rows(cases_with_flows(cases, flows, "Korea"), "flight_count") == [(None,)]


def test_marts_of_csv_files_take_aliases(spark, write):
    header = "year_month,Country_Region,Confirmed_cumulative,Deaths_cumulative,Recovered_cumulative,Active_cumulative,Confirmed_monthly_new,Deaths_monthly_new,Recovered_monthly_new,Active_monthly_new"
    cases = write("cases.csv", header, "2020-01,Korea,5,,,,,,,")
    flows = write("flows.csv", "year_month,origin_country,origin_country_code,destination_country,destination_country_code,flight_count", '2020-01,France,FR,"Korea, Republic of",KR,7')
    for aliases, want in (({"Korea": "Korea, Republic of"}, 7), ({}, None)):
        tables = marts_from_csv(spark, cases, cases, flows, "Korea", aliases=aliases)
        assert rows(tables["focus_with_flows"], "flight_count") == [(want,)]


@pytest.fixture
def pairs(spark):
    data = [("2020-01", "A", "a", "B", "b", 1), ("2020-01", "C", "c", "B", "b", 2), ("2020-02", "A", "a", "B", "b", 4), ("2020-02", "B", "b", "A", "a", 8), (None, "A", "a", "B", "b", 16)]
    return spark.createDataFrame(data, "month string, origin_country string, origin_country_code string, end_country string, destination_country_code string, flight_count long")


def test_levels_equal_their_own_queries(spark, pairs):
    found = flow_hierarchy(pairs)
    known = pairs.filter("month IS NOT NULL")
    for level, keys in LEVELS.items():
        for period, by in (("month", ["month", *keys]), ("all", list(keys))):
            own = known.groupBy(*by).agg(F.sum("flight_count").alias("flight_count"))
            assert rows(found.filter((F.col("level") == level) & (F.col("period") == period)), *by, "flight_count") == rows(own)
    ends = found.filter("level = 'destination' AND period = 'month'")
    assert rows(ends, "month", "end_country", "flight_count") == rows(destination_flows(known))


def test_levels_come_from_one_scan(spark, pairs, tmp_path):
    pairs.write.parquet(f"{tmp_path}/pairs")
    plan = flow_hierarchy(spark.read.parquet(f"{tmp_path}/pairs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_a_rerun_that_fails_leaves_the_old_result(spark, tmp_path):
    path = f"{tmp_path}/cases"
    write_batch(spark.range(3), path, batch="2020")
    broken = spark.range(5).selectExpr("IF(id = 4, raise_error('broken'), id) AS id")
    with pytest.raises(Exception, match="broken"):
        write_batch(broken, path, batch="2020")
    assert spark.read.parquet(path).count() == 3
    write_batch(spark.range(7), path, batch="2020")
    assert spark.read.parquet(path).count() == 7
    assert [p.name for p in (tmp_path / "cases").iterdir()] == ["areas=all"]


def test_a_run_killed_between_two_renames_is_put_right(spark, tmp_path):
    path = f"{tmp_path}/cases"
    write_batch(spark.range(3), path, batch="2020")
    place = partition_path(path, areas="all", batch="2020")
    import os

    os.rename(place, aside_of(place))
    broken = spark.range(5).selectExpr("raise_error('broken') AS id")
    with pytest.raises(Exception, match="broken"):
        write_batch(broken, path, batch="2020")
    assert spark.read.parquet(path).count() == 3
