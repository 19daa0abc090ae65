"""Monthly cases joined with monthly flows while files of both still arrive.

Both streams carry the first day of their month as event time. The join keeps rows
of either side until the watermark, the slower stream's latest month less a delay,
has passed their month: state is bounded by the months of the delay. A month of
cases that no flows have met by then is given out once, without flows. Flows that
come later than that are dropped by the join, and counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyflow.operators.filters import renamed_areas
from tallyflow.schemas import AREA_ALIASES

DELAY = "62 days"


def month_time(month: str) -> Column:
    """The first instant of a ``yyyy-MM`` month."""
    return F.to_timestamp(F.concat(F.col(month), F.lit("-01")), "yyyy-MM-dd")


def streamed_cases_with_flows(
    cases: DataFrame,
    flows: DataFrame,
    aliases: Mapping[str, str] = AREA_ALIASES,
    delay: str = DELAY,
) -> DataFrame:
    """The streaming form of :func:`tallyflow.plans.marts.cases_with_flows`.

    ``cases`` has month and country, ``flows`` month, end_country and flight_count, with
    one row per key on either side.
    """
    left = cases.withColumn("_at", month_time("month")).withWatermark("_at", delay)
    left = left.withColumn("_key", renamed_areas(F.col("country"), dict(aliases)))
    right = flows.select(
        month_time("month").alias("_flow_at"), F.col("end_country").alias("_flow_key"), "flight_count"
    ).withWatermark("_flow_at", delay)
    on = (F.col("_at") == F.col("_flow_at")) & (F.col("_key") == F.col("_flow_key"))
    return left.join(right, on, "left_outer").drop("_at", "_key", "_flow_at", "_flow_key")


def append_rows(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict[str, object] | None = None
) -> StreamingQuery:
    """Appends the rows that a stream gives out to Parquet files; each is written once."""
    return (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, in the micro-batches that the query still remembers."""
    return sum(
        int(operator["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
