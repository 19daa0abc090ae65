"""One run over a batch: both families of data, results and quality report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import named
from tallyflow.functions.text import areas_label
from tallyflow.operators.filters import (
    among,
    plausible_areas,
    renamed_areas,
    require_one_of,
    valid_days,
    with_values,
)
from tallyflow.operators.lookups import place_table
from tallyflow.operators.reshape import union_by_name
from tallyflow.operators.rollups import area_day_totals, area_months
from tallyflow.plans.flows import COMPLETE, count_flows, flow_order, map_flows, month_totals, spread_rows
from tallyflow.plans.incremental import refresh_totals
from tallyflow.plans.quality_report import flow_report, snapshot_report, unmatched_names
from tallyflow.plans.snapshots import days_from_totals
from tallyflow.schemas import AREA_ALIASES, SOURCE, SnapshotSpec
from tallyflow.session import drop_path, stage_path, staged
from tallyflow.sources import layouts, readers
from tallyflow.sources.batches import period_parts, report_day, report_glob
from tallyflow.sources.sinks import partition_path, write_batch, write_csv


@dataclass(frozen=True)
class BatchInputs:
    """Where the files of a run are: two folders and two files."""

    reports: str
    flows: str
    facilities: str
    codes: str


def run_batch(
    spark: SparkSession,
    inputs: BatchInputs,
    out: str,
    period: str = "*",
    areas: Iterable[str] | None = None,
    spec: SnapshotSpec = SnapshotSpec(),
    aliases: Mapping[str, str] = AREA_ALIASES,
    csv: str | None = None,
    *,
    layouts: str = "declared",
    revisions: str = "all",
    store: str | None = None,
    gaps: str = "keep",
    resets: str = "keep",
) -> dict[str, str]:
    """Runs a batch and returns the path of each dataset written.

    Each family of raw files is read once, down to a table bounded by days
    and areas, or months and pairs of countries. Results and quality lines
    come from those. ``cases`` always holds all areas, and the chosen ones in a
    partition of their own; ``flows`` counts flows into the chosen areas.
    ``aliases`` gives the names of areas in the codes table where they differ.
    ``csv`` is a folder for the same results as CSV. Stages are kept below
    ``out`` while the run lasts.

    ``layouts="header"`` reads report files by the names in their headers, which
    keeps the months of early 2020, and lists the files with an unknown header.
    ``revisions="latest"`` counts the latest report of a place and day, for files that
    repeat those of other periods. ``store`` is a folder that keeps day totals from run
    to run: only files that are new or changed since the last run of this period
    with it are read. ``gaps`` and ``resets`` are those of ``days_from_totals``; falls
    that are carried on are listed in the quality report.
    """
    require_one_of("layouts", layouts, LAYOUTS)
    if store is not None and revisions != "all":
        raise ValueError("a store adds up all reports, so it has no latest revisions")
    stages = stage_path(spark, "_stages", out)
    scan = ReportScan(layouts, revisions, store, gaps, resets)
    try:
        return _run_batch(spark, inputs, out, period, areas, spec, aliases, csv, stages, scan)
    finally:
        drop_path(spark, stages)


LAYOUTS = ("declared", "header")


@dataclass(frozen=True)
class ReportScan:
    """How the reports of a run are read and made into days."""

    layouts: str
    revisions: str
    store: str | None
    gaps: str
    resets: str


def report_totals(
    spark: SparkSession, folder: str, period: str, spec: SnapshotSpec, scan: ReportScan, stages: str
) -> tuple[DataFrame, DataFrame]:
    """Day totals of the reports, and quality lines about files that could not be read."""
    glob = f"{folder}/{report_glob(period)}"
    odd: dict[str, str] = {}

    def read(files: str | Sequence[str]) -> DataFrame:
        if scan.layouts == "declared":
            return readers.read_report_files(spark, files)
        found = layouts.routed(layouts.file_headers(spark, files))
        odd.update(found.unknown)
        return layouts.read_routed(spark, found)

    if scan.store is not None:
        batch = "all" if period == "*" else period
        store = f"{scan.store.rstrip('/')}/{batch}-{scan.layouts}"
        kept = refresh_totals(spark, glob, store, read, spec, notes=lambda: odd)
        totals, notes = kept.totals, kept.notes
    else:
        rows = read(glob)
        version = report_day(F.col(SOURCE))
        totals = staged(area_day_totals(rows, spec, revisions=scan.revisions, version=version), "totals", stages)
        notes = spark.createDataFrame(sorted(odd.items()), "file STRING, note STRING")
    name = F.concat_ws(": ", F.substring_index("file", "/", -1), "note")
    return totals, notes.select(F.lit("unknown_header").alias("section"), name.alias("metric"), F.lit(1.0).alias("value"))


def _run_batch(
    spark: SparkSession,
    inputs: BatchInputs,
    out: str,
    period: str,
    areas: Iterable[str] | None,
    spec: SnapshotSpec,
    aliases: Mapping[str, str],
    csv: str | None,
    stages: str,
    scan: ReportScan,
) -> dict[str, str]:
    period_parts(period)
    chosen = list(areas or [])
    batch = "all" if period == "*" else period
    label = areas_label(chosen)
    paths = {name: f"{out.rstrip('/')}/{name}" for name in ("cases", "flows", "quality")}

    totals, odd_files = report_totals(spark, inputs.reports, period, spec, scan, stages)
    days = days_from_totals(totals, spec, gaps=scan.gaps, resets=scan.resets)
    months = area_months(days, spec)
    case_order = [spec.area, "year_month"]

    def result(df: DataFrame, name: str, areas: str, sort: list[str]) -> None:
        write_batch(df, paths[name], batch=batch, areas=areas, sort=sort)
        if csv is not None:
            write_csv(df, partition_path(f"{csv.rstrip('/')}/{name}", areas=areas, batch=batch), sort)

    result(months, "cases", "all", case_order)
    if chosen:
        result(among(months, spec.area, chosen), "cases", label, case_order)

    facilities = readers.read_facilities(spark, inputs.facilities)
    codes = readers.read_codes(spark, inputs.codes)
    flows = spread_rows(readers.read_flows(spark, inputs.flows, period))
    mapped = map_flows(flows, place_table(facilities, codes), keep_incomplete=True)
    flow_totals = staged(month_totals(mapped), "flows", stages)
    counts = count_flows(
        with_values(flow_totals, COMPLETE),
        "destination",
        "year_month",
        [aliases.get(a, a) for a in chosen],
    )
    result(counts, "flows", label, flow_order("destination", "year_month"))

    # The areas of the results, without their aggregates and windows.
    kept = plausible_areas(valid_days(totals, "date", spec), spec.area)
    areas_seen = kept.select(renamed_areas(named(spec.area), dict(aliases)).alias("area")).distinct()
    lines = union_by_name(
        [
            snapshot_report(totals, spec, scan.resets),
            flow_report(flow_totals, facilities),
            unmatched_names(areas_seen, "area", codes, "country"),
            odd_files,
        ]
    )
    write_batch(lines, paths["quality"], batch=batch, areas=label)
    return paths
