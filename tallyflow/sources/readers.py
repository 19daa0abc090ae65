"""Readers with declared schemas.

No schema is inferred from values. Readers of text columns look at the header
of one file when the frame is made; the others open no file before the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow import schemas
from tallyflow.functions.columns import named
from tallyflow.schemas import LAYOUT, REJECTED, SOURCE
from tallyflow.sources.batches import flow_glob, report_glob



def read_declared(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str,
    *,
    mode: str = "PERMISSIVE",
    whole_rows: bool = False,
    missing_ok: bool = False,
    **options: str,
) -> DataFrame:
    """CSV with a header under a declared schema; any Hadoop URI will do.

    ``whole_rows`` turns column pruning off in the parser, so that a row with
    the wrong number of fields counts as malformed however few columns are
    used. ``missing_ok`` gives an empty frame of the same schema when no file
    matches. Timestamps without a zone are read as UTC.
    """
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", mode)
        .option("timeZone", "UTC")
    )
    if whole_rows:
        reader = reader.option("columnPruning", False)
    for key, value in options.items():
        reader = reader.option(key, value)
    try:
        return reader.csv(paths if isinstance(paths, str) else list(paths))
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_reports(
    spark: SparkSession, folder: str, period: str = "*", *, rejects: bool = False
) -> DataFrame:
    """Daily reports of a period, without malformed rows or with ``rejects``.

    Files of spring 2020 end after twelve fields and agree with ours up to
    there. Such a row is malformed at first, and its line is then parsed under
    the shorter layout in the same scan. Rows of other layouts stay rejected.
    A bad value drops its row only when the column is used.
    """
    rows = read_report_files(spark, f"{folder}/{report_glob(period)}")
    return rows if rejects else kept_rows(rows)


def read_report_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All rows of report files, with what is rejected, under the declared layouts."""
    rows = read_with_rejects(spark, paths, schemas.DAILY_REPORT, missing_ok=True)
    rows = rows.withColumn(SOURCE, F.input_file_name())
    return with_second_layout(rows, schemas.DAILY_REPORT_12)


def with_second_layout(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of :func:`read_with_rejects`, rejected lines read again under ``schema``.

    ``_layout`` tells the number of fields a row was read with, 0 if rejected. Lines
    with too few commas for ``schema`` are not read again, as parsing those that fail is dear.
    """
    again, bad = "_again", "_bad_again"
    shorter = T.StructType.fromDDL(schema)
    line = named(REJECTED)
    enough = F.length(line) - F.length(F.replace(line, F.lit(","))) >= len(shorter) - 1
    options = {
        "mode": "PERMISSIVE",
        "timeZone": "UTC",
        "columnPruning": "false",
        "columnNameOfCorruptRecord": bad,
    }
    parsed = F.from_csv(named(REJECTED), f"{schema}, {bad} STRING", options)
    rows = rows.withColumn(again, F.when(enough, parsed))
    columns = [c for c in rows.columns if c not in (REJECTED, SOURCE, again)]
    # A line may be NULL as a whole where a value of an unread column is bad.
    second = F.coalesce(enough, F.lit(False)) & F.col(again)[bad].isNull()
    return rows.select(
        *[
            F.when(second, F.col(again)[c] if c in shorter.names else F.lit(None))
            .otherwise(named(c))
            .cast(rows.schema[c].dataType)
            .alias(c)
            for c in columns
        ],
        F.when(~second, named(REJECTED)).alias(REJECTED),
        F.when(second, len(shorter)).when(named(REJECTED).isNull(), len(columns)).otherwise(0).alias(LAYOUT),
        *[c for c in rows.columns if c == SOURCE],
    )


def layout_profile(rows: DataFrame, source: str = SOURCE) -> DataFrame:
    """Number of rows per file and layout; a file that is rejected whole shows up.

    ``dated_rows`` are accepted ones with a readable day.
    """
    dated = (F.col(LAYOUT) > 0) & F.col("Last_Update").isNotNull()
    return rows.groupBy(named(source), LAYOUT).agg(
        F.count("*").alias("report_rows"), F.count_if(dated).alias("dated_rows")
    )


def read_with_rejects(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str,
    *,
    missing_ok: bool = False,
    **options: str,
) -> DataFrame:
    """Every row, malformed ones with their text in ``_rejected_line``.

    Kept rows are those where that column is NULL; one scan serves both.
    """
    return read_declared(
        spark,
        paths,
        f"{schema}, {REJECTED} STRING",
        whole_rows=True,
        missing_ok=missing_ok,
        columnNameOfCorruptRecord=REJECTED,
        **options,
    )


def kept_rows(rows: DataFrame) -> DataFrame:
    """The well-formed rows of :func:`read_with_rejects`."""
    return rows.filter(named(REJECTED).isNull()).drop(REJECTED, LAYOUT, SOURCE)


def scan_profile(rows: DataFrame) -> DataFrame:
    """One row: rows kept, rows rejected, and values per column in kept rows.

    A value is checked only when its column is read, so the count of values
    also makes sure that every column has been looked at.
    """
    kept = named(REJECTED).isNull()
    used = [c for c in rows.columns if c != REJECTED]
    return rows.agg(
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("rejected"),
        *[F.count_if(kept & named(c).isNotNull()).alias(c) for c in used],
    )


def read_text_columns(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Columns of CSV files as text, found by header name.

    The names come from one file. The others must have the same header, which
    ``enforceSchema`` checks as each is opened: a file with another order of
    columns ends the query instead of being misread.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*[named(c) for c in columns]) if columns else rows


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    return read_text_columns(spark, path, schemas.FACILITY_COLUMNS)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Names and two-letter codes; ``NA`` is a code like any other."""
    return read_text_columns(
        spark, path, [schemas.CODE_NAME_COLUMN, schemas.CODE_COLUMN]
    ).withColumnsRenamed(
        {schemas.CODE_NAME_COLUMN: "country", schemas.CODE_COLUMN: "country_code"}
    )


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of names, ``area`` and ``known_as``, from the first two columns of a CSV file."""
    rows = read_text_columns(spark, path)
    area, known_as = rows.columns[:2]
    return rows.select(named(area).alias("area"), named(known_as).alias("known_as"))


def read_aliases(spark: SparkSession, path: str, most: int = 10_000) -> dict[str, str]:
    """The same for the driver, where chosen areas are named; an error beyond ``most`` pairs."""
    pairs = alias_table(spark, path).dropna().limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError(f"more than {most} aliases")
    return {r["area"]: r["known_as"] for r in pairs}


def read_flows(spark: SparkSession, folder: str, period: str = "*") -> DataFrame:
    """Flow files of a period, narrowed to the three used columns.

    ``day`` stays text here: it is the day as written in the file, whatever
    the session time zone.
    """
    path = f"{folder}/{flow_glob(period)}"
    try:
        return read_text_columns(spark, path, schemas.FLOW_COLUMNS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} STRING" for c in schemas.FLOW_COLUMNS))


def read_monthly_cases(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Monthly case files of all batches in one read, measures as integers.

    Whole numbers may be written ``12`` or ``12.0``; both are read.
    ``source_file`` tells which file a row came from.
    """
    rows = read_declared(spark, paths, schemas.MONTHLY_CASES)
    keys = [c for c, t in rows.dtypes if t == "string"]
    return rows.select(
        *[named(c) for c in keys],
        *[named(c).cast("long").alias(c) for c in rows.columns if c not in keys],
        F.col("_metadata.file_path").alias("source_file"),
    )


def read_flow_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    rows = read_declared(spark, paths, schemas.FLOW_COUNTS)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


def read_partitioned(
    spark: SparkSession, path: str, columns: T.StructType, partitions: Sequence[str]
) -> DataFrame:
    """A Parquet dataset written by this package.

    The directory values are declared as text, or Spark would take a batch
    such as 202101 for a number and a month for a date.
    """
    schema = T.StructType([f for f in columns.fields if f.name not in partitions])
    for name in partitions:
        schema = schema.add(name, T.StringType())
    return spark.read.schema(schema).parquet(path)


def read_end_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows by destination with a month such as 202101."""
    return read_declared(spark, path, schemas.END_FLOWS)


def read_wide_series(spark: SparkSession, path: str) -> DataFrame:
    """A series with one column per date, all columns as text."""
    return read_text_columns(spark, path)
