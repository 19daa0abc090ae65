"""Reruns, labels, stages, overlapping batches and the shorter report layout."""

from __future__ import annotations

import gzip
from pathlib import Path

import pytest

from tallyflow.plans.batch_job import BatchInputs, run_batch
from tallyflow.plans.marts import marts_from_csv, marts_from_results, widest_batches
from tallyflow.session import require_local
from tallyflow.sources import readers
from tallyflow.sources.sinks import write_batch
from tests.conftest import rows
from tests.test_batch_job import CASES, FLOWS, QUALITY, dataset, inputs  # noqa: F401
from tests.test_sources import HEADER, OLD_HEADER, report

SHORT_HEADER = ",".join(HEADER.split(",")[:12])


def short(area, stamp, confirmed):
    return f'1,Adm,Prov,{area},{stamp},1.5,2.5,{confirmed},1,2,7,"Adm, Prov"'


def test_twelve_fields_are_kept_and_counted(spark, write, tmp_path):
    write("01-01-2021.csv", HEADER, report("US"))
    write("01-02-2021.csv", SHORT_HEADER, short("US", "2021-01-02 05:00:00", 5), short("FR", "2021-01-02 05:00:00", "x"))
    write("01-03-2021.csv", OLD_HEADER, "A,US,2021-01-02,65187,2615,20969")
    got = readers.read_reports(spark, str(tmp_path)).select("Country_Region", "Confirmed", "Combined_Key", "Incident_Rate")
    assert [r[:3] for r in rows(got)] == [("US", 10, "Adm, Prov"), ("US", 5, "Adm, Prov")]
    counted = readers.layout_profile(readers.read_reports(spark, str(tmp_path), rejects=True))
    found = {(Path(r[0]).name, r["_layout"]): r["report_rows"] for r in counted.collect()}
    assert found[("01-01-2021.csv", 14)] == 1 and found[("01-03-2021.csv", 0)] == 1
    assert found[("01-02-2021.csv", 12)] >= 1


def test_run_over_twelve_fields(spark, inputs, write, tmp_path):  # noqa: F811
    write("reports/05-01-2020.csv", SHORT_HEADER, short("US", "2020-05-01 05:00:00", 7), short("US", "2020-05-02 05:00:00", 9))
    paths = run_batch(spark, inputs, str(tmp_path / "out"), "202005", ["US"])
    assert rows(dataset(spark, paths["cases"], CASES).filter("areas = 'US'")) == [("2020-05", "US", 9, 2, "US", "202005")]
    lines = {(r.section, r.metric): r.value for r in dataset(spark, paths["quality"], QUALITY).collect()}
    assert lines["scan", "rejected_rows"] == 0 and lines["reports", "rows"] == 2


def test_empty_rerun_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([("2021-01", 1)], "year_month string, n long")
    write_batch(df, path, batch="202101", areas="a b,c%2Cd")
    write_batch(df, path, batch="202102")
    read = lambda: rows(readers.read_partitioned(spark, path, df.schema, ["areas", "batch"]))
    assert read() == [("2021-01", 1, "a b,c%2Cd", "202101"), ("2021-01", 1, "all", "202102")]
    write_batch(df.limit(0), path, batch="202101", areas="a b,c%2Cd")
    assert read() == [("2021-01", 1, "all", "202102")]


def test_order_of_areas_does_not_matter_and_stages_go(spark, inputs, tmp_path):  # noqa: F811
    out = tmp_path / "out"
    for areas in (["US", "France"], ["France", "US"]):
        paths = run_batch(spark, inputs, str(out), "2021", areas)
    assert rows(dataset(spark, paths["cases"], CASES).select("areas").distinct()) == [("France,US",), ("all",)]
    assert sorted(p.name for p in out.iterdir()) == ["cases", "flows", "quality"]


def test_only_a_local_session_may_lack_a_shared_folder():
    require_local("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            require_local(master)


def test_batches_inside_others_are_left_out(spark, inputs, tmp_path):  # noqa: F811
    df = spark.createDataFrame([("2021",), ("202101",), ("202001",), ("20211",)], "batch string")
    assert rows(widest_batches(df)) == [("202001",), ("2021",)]
    out = str(tmp_path / "out")
    for period in ("2020", "2021", "202101"):
        run_batch(spark, inputs, out, period, ["US"])
    focus = marts_from_results(spark, out)["focus_with_flows"]
    assert rows(focus, "month", "Confirmed_cumulative", "flight_count") == [("2020-12", 90, 1), ("2021-01", 150, 2)]


def test_csv_results_make_the_same_marts(spark, inputs, tmp_path):  # noqa: F811
    out, csv = str(tmp_path / "out"), str(tmp_path / "csv")
    for period in ("2020", "2021"):
        run_batch(spark, inputs, out, period, ["US"], csv=csv)
    from_csv = marts_from_csv(spark, f"{csv}/cases/areas=all/batch=*", f"{csv}/cases/areas=US/batch=*", f"{csv}/flows/areas=US/batch=*")
    for name, df in marts_from_results(spark, out).items():
        assert rows(df) == rows(from_csv[name], *df.columns), name


def test_aliases_are_an_input(spark, inputs, write, tmp_path):  # noqa: F811
    path = write("aliases.csv", "area,known_as", "US,France", "x,")
    aliases = readers.read_aliases(spark, path)
    assert aliases == {"US": "France"}
    paths = run_batch(spark, inputs, str(tmp_path / "out"), "2021", ["US"], aliases=aliases)
    flows = dataset(spark, paths["flows"], FLOWS)
    assert rows(flows.select("destination_country").distinct()) == [("France",)]


def test_abnormal_days_are_shown(spark, inputs, tmp_path):  # noqa: F811
    paths = run_batch(spark, inputs, str(tmp_path / "out"), "202101")
    shown = dataset(spark, paths["quality"], QUALITY).filter("section = 'abnormal_day'")
    assert rows(shown, "metric", "value") == [("2615-01-01 US", 1.0)]


def test_one_gzip_file_is_mapped_by_many_tasks(spark, conf, tmp_path):
    folder = tmp_path / "flights"
    folder.mkdir()
    lines = ["day,origin,destination"] + [f"2021-01-01 00:00:00+00:00,O{i},D{i % 977}" for i in range(60_000)]
    (folder / "flightlist_20210101_20210131.csv.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    small = {"spark__sql__adaptive__advisoryPartitionSizeInBytes": "64k", "spark__sql__adaptive__coalescePartitions__minPartitionSize": "16k"}
    with conf(**small):
        spread = readers.read_flows(spark, str(folder)).hint("rebalance")
        assert spread.count() == 60_000
        assert spread.rdd.getNumPartitions() > 1
