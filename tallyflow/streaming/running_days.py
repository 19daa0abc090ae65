"""Day totals and their changes from a stream of report files, in whatever order they come.

Two steps, each with a state bounded by days and areas:

* Spark keeps the sums per day and area. The key holds the day, so rows of an area with
  most of the reports are added up before they are shuffled, like any others.
* Each micro-batch takes the totals that changed and revises them in the table of
  results: the changed day itself, and the next known day of its area, whose change
  depends on it. A late row thus moves two days, however long ago they were.

The table is a log of revisions, the newest of each day and area counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.functions.calendar import utc_day
from tallyflow.functions.columns import named
from tallyflow.operators.deltas import step_changes
from tallyflow.operators.filters import plausible_areas, valid_days
from tallyflow.schemas import SnapshotSpec
from tallyflow.streaming.running_counts import keep_updated, latest_values

DAY = "date"


def running_totals(reports: DataFrame, spec: SnapshotSpec = SnapshotSpec()) -> DataFrame:
    """Sums of the measures per day and area of a stream, for valid days and plausible areas."""
    valid = plausible_areas(valid_days(reports, spec.stamp, spec), spec.area)
    sums = [F.sum(named(m)).alias(c) for m, c in zip(spec.measures, spec.cumulative)]
    return valid.groupBy(utc_day(valid, spec.stamp).alias(DAY), named(spec.area)).agg(*sums)


def revised_days(changed: DataFrame, known: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Days whose total or change is new, after ``changed`` totals replace the ``known`` ones.

    Only areas with a changed day are looked at. Both frames have one row per day and area.
    """
    keys = [DAY, spec.area]
    columns = [*keys, *spec.cumulative]
    areas = changed.select(named(spec.area)).distinct()
    # An area may be NULL, as in the batch tables.
    same_area = known[spec.area].eqNullSafe(areas[spec.area])
    kept = known.join(areas, same_area, "left_semi").select(*[named(c) for c in columns])
    fresh = changed.select(*[named(c) for c in columns])
    newest = (
        kept.withColumn("_new", F.lit(False))
        .unionByName(fresh.withColumn("_new", F.lit(True)))
        .groupBy(*[named(k) for k in keys])
        .agg(
            *[F.max_by(named(c), F.col("_new")).alias(c) for c in spec.cumulative],
            F.max("_new").alias("_new"),
        )
    )
    days = step_changes(newest, spec.area, DAY, dict(zip(spec.daily_new, spec.cumulative)))
    before = F.lag("_new", 1, False).over(Window.partitionBy(named(spec.area)).orderBy(DAY))
    touched = days.withColumn("_touched", F.col("_new") | before)
    return touched.filter("_touched").select(*[named(c) for c in [*columns, *spec.daily_new]])


def keep_days_updated(
    totals: DataFrame,
    path: str,
    checkpoint: str,
    spec: SnapshotSpec = SnapshotSpec(),
    compact_every: int = 0,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Writes the revised days of each micro-batch of :func:`running_totals` below ``path``."""
    return keep_updated(
        totals,
        path,
        checkpoint,
        [DAY, spec.area],
        compact_every,
        trigger,
        revise=lambda changed, known: revised_days(changed, known, spec),
    )


def latest_days(spark: SparkSession, path: str, spec: SnapshotSpec = SnapshotSpec()) -> DataFrame:
    """The country-day table as far as the stream has come."""
    return latest_values(spark, path, [DAY, spec.area])
