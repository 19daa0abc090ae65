"""The quality report of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.calendar import day_text
from tallyflow.functions.columns import named
from tallyflow.operators.lookups import repeated_keys, unmatched
from tallyflow.operators.matching import name_candidates
from tallyflow.operators.quality import abnormal_sample, day_audit, null_profile, report_lines
from tallyflow.operators.reshape import union_by_name
from tallyflow.operators.rollups import REJECTS, ROWS, SUPERSEDED
from tallyflow.plans.flows import WEIGHT
from tallyflow.plans.snapshots import days_from_totals, total_resets
from tallyflow.schemas import SnapshotSpec


def snapshot_report(totals: DataFrame, spec: SnapshotSpec, resets: str = "keep") -> DataFrame:
    """Lines for the reports and for the country-day table made of them.

    Reads the day totals, where each row knows how many reports it stands for.
    With ``resets="carry"`` each fall of a total is a line too.
    """
    scanned = [c for c in (REJECTS, SUPERSEDED) if c in totals.columns]
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in scanned])
    return union_by_name(
        [
            report_lines(sums, "scan"),
            report_lines(day_audit(totals, "date", spec, weight=ROWS), "reports"),
            report_lines(null_profile(days_from_totals(totals, spec, resets=resets)), "area_day_nulls"),
            abnormal_lines(totals, spec),
            *([reset_lines(totals, spec)] if resets == "carry" else []),
        ]
    )


def reset_lines(totals: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """A line for each fall of a total: day, area and measure, and by how much it fell."""
    return total_resets(totals, spec).select(
        F.lit("reset").alias("section"),
        F.concat_ws(" ", day_text(F.col("date")), named(spec.area), "measure").alias("metric"),
        F.col("drop").cast("double").alias("value"),
    )


def abnormal_lines(totals: DataFrame, spec: SnapshotSpec, n: int = 10) -> DataFrame:
    """The first ``n`` days and areas out of the years, with their number of reports."""
    counted = totals.filter(F.col(ROWS) > 0)
    sample = abnormal_sample(counted, "date", spec, ["date", spec.area], n)
    return sample.select(
        F.lit("abnormal_day").alias("section"),
        F.concat_ws(" ", F.coalesce(day_text(F.col("date")), F.lit("no day")), F.col(spec.area)).alias("metric"),
        F.col(ROWS).cast("double").alias("value"),
    )


def flow_report(mapped: DataFrame, facilities: DataFrame) -> DataFrame:
    """Lines for mapped flows, incomplete ones included, and the facilities."""
    weight = WEIGHT if WEIGHT in mapped.columns else None
    repeats = repeated_keys(facilities, "icao").agg(F.count("*").alias("repeated_facilities"))
    return union_by_name(
        [
            report_lines(null_profile(mapped, weight), "flow_nulls"),
            report_lines(repeats, "facilities"),
        ]
    )


def unmatched_names(names: DataFrame, name: str, known: DataFrame, known_name: str) -> DataFrame:
    """Names the other table does not know: their number, a line for each, and the likeliest name.

    The value of a candidate's line is its score, 1 less the share of letters that differ.
    """
    missing = unmatched(names, name, known, known_name)
    total = report_lines(missing.agg(F.count("*").alias("unmatched_names")), "names")
    each = missing.select(
        F.lit("unmatched_name").alias("section"),
        F.col(name).alias("metric"),
        F.lit(1.0).alias("value"),
    )
    likeliest = name_candidates(missing, name, known, known_name).select(
        F.lit("name_candidate").alias("section"),
        F.concat_ws(" is ", F.col(name), "candidate").alias("metric"),
        F.col("score").alias("value"),
    )
    return union_by_name([total, each, likeliest])
