"""Writers; every one leaves the data distributed."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.calendar import month_text, utc_day
from tallyflow.session import drop_path, restore_path, stage_path, swap_path

RESULT_PARTITIONS = ("areas", "batch")


def write_batch(
    df: DataFrame,
    path: str,
    *,
    batch: str,
    areas: str = "all",
    sort: Sequence[str] = (),
) -> None:
    """Writes a result as the partition ``areas=.../batch=...`` of a dataset.

    A rerun of the same batch replaces its own partition and no other, also if
    it has no rows. The new one is written beside and put in its place when it is
    complete, so a rerun that fails leaves the old one. Batches are written to
    directories of their own, so two of them can run at once.
    """
    if sort:
        df = df.orderBy(*sort)
    spark, place = df.sparkSession, partition_path(path, areas=areas, batch=batch)
    restore_path(spark, place)
    beside = stage_path(spark, "_new", path)
    try:
        df.write.parquet(beside)
        swap_path(spark, beside, place)
    finally:
        drop_path(spark, beside)


def partition_path(path: str, **values: str) -> str:
    """Directory of a partition, with values escaped as Spark reads them."""
    return "/".join([path.rstrip("/"), *(f"{k}={quote(v, safe=' ')}" for k, v in values.items())])


def write_csv(df: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """CSV export with a header in each part file, in order of part number."""
    if sort:
        df = df.orderBy(*sort)
    df.write.mode("overwrite").option("header", True).csv(path)


def land_by_month(
    df: DataFrame, path: str, stamp: str, *, month: str = "year_month"
) -> None:
    """Lands raw rows as Parquet with one directory per month.

    The rebalance hint lets AQE split a heavy month over several tasks and
    files and join the small ones; rows without a month keep a directory too.
    """
    months: Column = month_text(utc_day(df, stamp))
    (
        df.withColumn(month, months)
        .hint("rebalance", F.col(month))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(month)
        .parquet(path)
    )
