"""Counts kept up to date from a stream of files.

The batch operators work on streaming frames as they are; this module adds
the sink. The state of a count is one number per day and key, bounded by the
calendar and the key domain, so a watermark is optional: input files hold rows
of other periods, and without a watermark those still reach their day.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyflow.functions.calendar import utc_day
from tallyflow.functions.columns import named

WHOLE, STARTED, BATCH = "whole", "started", "batch_id"


def daily_counts(
    rows: DataFrame,
    stamp: str,
    keys: Sequence[str],
    late_after: str | None = None,
) -> DataFrame:
    """Rows per day and key. ``late_after`` sets a watermark on ``stamp``."""
    if late_after is None:
        return (
            rows.groupBy(utc_day(rows, stamp).alias("day"), *[named(k) for k in keys])
            .agg(F.count("*").alias("n"))
        )
    marked = rows.withColumn(stamp, named(stamp).cast("timestamp")).withWatermark(
        stamp, late_after
    )
    return (
        marked.groupBy(F.window(named(stamp), "1 day"), *[named(k) for k in keys])
        .agg(F.count("*").alias("n"))
        .select(F.to_date("window.start").alias("day"), *[named(k) for k in keys], "n")
    )


def keep_updated(
    counts: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    compact_every: int = 0,
    trigger: dict[str, object] | None = None,
    revise: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Writes the changed values of each micro-batch below ``path``.

    A micro-batch that is run again replaces its own directory, or after a restart
    counts instead of it, so a failure between writing and committing leaves no
    double. Directories carry the number of the query, one more than the largest
    that is stored there: with a lost checkpoint a new query numbers its
    micro-batches from 0, and the later query counts, whatever a clock says.
    Every ``compact_every`` micro-batches the newest values of each of ``keys`` so
    far are written as one of them, and older ones need not be read any more.
    ``revise`` makes what is written from the changed rows and the newest rows before.
    ``trigger`` is handed to Spark; without one, all there is gets processed.
    """
    spark = counts.sparkSession
    started = next_query(spark, path)

    def save(changed: DataFrame, batch_id: int) -> None:
        whole = bool(compact_every) and batch_id % compact_every == compact_every - 1
        if whole or revise:
            order = F.lit(batch_id)
            like = changed if revise is None else revise(changed, spark.createDataFrame([], changed.schema))
            older = latest_rows(spark, path, like).filter((F.col(STARTED) != started) | (F.col(BATCH) < order))
            if revise:
                changed = revise(changed, newest_values(older, keys))
            if whole:
                newest = older.drop(WHOLE).unionByName(
                    changed.withColumns({STARTED: F.lit(started), BATCH: order.cast("long")})
                )
                changed = newest_values(newest, keys)
        changed.write.mode("overwrite").parquet(
            f"{path}/{WHOLE}={str(whole).lower()}/{STARTED}={started}/{BATCH}={batch_id}"
        )

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Changes since the newest whole table below ``path``, that table included."""
    parts = T.StructType([f for f in like.schema.fields if f.name not in (WHOLE, STARTED, BATCH)])
    schema = parts.add(WHOLE, "boolean").add(STARTED, "string").add(BATCH, "long")
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    at = F.struct(STARTED, BATCH)
    # One row from directory names; what is older is then not read at all.
    newest = rows.filter(WHOLE).select(at.alias("at")).agg(F.max("at").alias("at")).first()["at"]
    if newest is None:
        return rows
    same = (F.col(STARTED) == newest[STARTED]) & (F.col(BATCH) >= newest[BATCH])
    return rows.filter((F.col(STARTED) > newest[STARTED]) | same)


def newest_values(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest values of each key among rows of :func:`latest_rows`."""
    values = [c for c in rows.columns if c not in (*keys, WHOLE, STARTED, BATCH)]
    newest = F.max_by(F.struct(*[named(v) for v in values]), F.struct(STARTED, BATCH))
    grouped = rows.groupBy(*[named(k) for k in keys]).agg(newest.alias("_newest"))
    return grouped.select(
        *[named(k) for k in keys], *[F.col("_newest").getField(v).alias(v) for v in values]
    )


def next_query(spark: SparkSession, path: str) -> str:
    """The number of a new query on ``path``, as text of even width; read from directory names."""
    try:
        last = spark.read.schema(f"{WHOLE} BOOLEAN, {STARTED} STRING, {BATCH} LONG").parquet(path).agg(F.max(STARTED)).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return f"{int(last or 0) + 1:020d}"


def latest_values(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key among all micro-batches."""
    changes = spark.read.parquet(path).drop(WHOLE, STARTED, BATCH)
    return newest_values(latest_rows(spark, path, changes), keys)


def latest_counts(
    spark: SparkSession, path: str, keys: Sequence[str], value: str = "n"
) -> DataFrame:
    """The newest value of each key among all micro-batches."""
    return latest_values(spark, path, keys).select(*[named(k) for k in keys], named(value))
