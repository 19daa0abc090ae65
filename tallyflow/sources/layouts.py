"""Report files of several layouts in one folder, told apart by their headers.

The first line of each file is found by a scan of the raw text, in parallel and
without parsing it. Files with the same columns are one group, which is read in
one go under a schema of its own: columns go by name, whatever their order, and
what a layout lacks is NULL. Files with a header that names no known layout are
listed, and their lines count as rejected.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow import schemas
from tallyflow.functions.columns import named
from tallyflow.operators.reshape import union_by_name
from tallyflow.schemas import LAYOUT, REJECTED, SOURCE
from tallyflow.sources import readers
from tallyflow.sources.batches import report_glob

STAMP = "Last_Update"


@dataclass(frozen=True)
class Routed:
    """Files by the columns they have, and the files of no known layout with their headers."""

    groups: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    unknown: dict[str, str] = field(default_factory=dict)


def key_of(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def columns_of(header: str) -> tuple[str, ...] | None:
    """Our names for the columns of a header, an empty one for those we do not use.

    None if a column is named twice, or one that every report has is missing.
    """
    ours = {key_of(c): c for c in T.StructType.fromDDL(schemas.DAILY_REPORT).names}
    ours.update({key_of(old): new for old, new in schemas.EARLIER_REPORT_NAMES.items()})
    found = tuple(ours.get(key_of(c), "") for c in next(csv.reader([header]), []))
    used = [c for c in found if c]
    if len(set(used)) < len(used) or not set(schemas.REPORT_ESSENTIALS) <= set(used):
        return None
    return found


def file_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file and header, the first line of each file that has one."""
    try:
        lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file STRING, header STRING")
    place = lines.metadataColumn("_metadata")
    # Lines of a file keep their order within its first block, which one task reads.
    return (
        lines.select("value", place["file_path"].alias("file"), place["file_block_start"].alias("start"))
        .filter("start = 0 AND value <> ''")
        .withColumn("at", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("value", "at").alias("header"))
    )


def routed(headers: DataFrame) -> Routed:
    """Groups the files of :func:`file_headers`; one short row a file, like Spark's own list of files."""
    found = Routed()
    for row in headers.groupBy("header").agg(F.collect_list("file").alias("files")).collect():
        columns = columns_of(row["header"])
        # Spark reports a path as a URI and reads it as plain text.
        files = sorted(unquote(f) for f in row["files"])
        if columns is None:
            found.unknown.update({f: row["header"] for f in files})
        else:
            found.groups.setdefault(columns, []).extend(files)
    return found


def stamp_of_text(text: Column) -> Column:
    """Time of a report as written; besides ISO, months first and with two or four digits of the year.

    Two-digit years from 69 on belong to the last century.
    """
    american = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s+(\d{1,2}:\d{2})(:\d{2})?\s*$"
    part = [F.regexp_extract(text, american, i) for i in range(6)]
    century = F.when(part[3] >= "69", "19").otherwise("20")
    year = F.when(F.length(part[3]) == 2, F.concat(century, part[3])).otherwise(part[3])
    seconds = F.when(part[5] == "", F.lit(":00")).otherwise(part[5])
    iso = F.concat(year, F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "), part[4], seconds)
    return F.when(part[0] != "", iso).otherwise(text).try_cast("timestamp_ntz")


def read_group(spark: SparkSession, columns: Sequence[str], files: Sequence[str]) -> DataFrame:
    """Rows of files with these columns, in our layout; rows with another number of fields are rejected."""
    ours = T.StructType.fromDDL(schemas.DAILY_REPORT)
    kinds = {f.name: f.dataType.simpleString() for f in ours} | {STAMP: "string"}
    declared = ", ".join(f"{c} {kinds[c]}" if c else f"_unread_{i} string" for i, c in enumerate(columns))
    rows = readers.read_with_rejects(spark, files, declared)
    stamp = stamp_of_text(named(STAMP)) if STAMP in columns else F.lit(None).cast("timestamp_ntz")
    # A time that cannot be read makes a row malformed, as in a declared scan.
    odd = named(STAMP).isNotNull() & stamp.isNull()
    rejected = F.coalesce(named(REJECTED), F.when(odd, F.concat(F.lit("time: "), named(STAMP))))
    return rows.select(
        *[
            (stamp if c == STAMP else named(c) if c in columns else F.lit(None).cast(kinds[c])).alias(c)
            for c in ours.names
        ],
        rejected.alias(REJECTED),
        F.when(rejected.isNull(), len(columns)).otherwise(0).alias(LAYOUT),
        F.input_file_name().alias(SOURCE),
    )


def read_unknown(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Lines of files of no known layout, all of them rejected."""
    # No line holds the separator, so a line is one field.
    lines = readers.read_declared(spark, files, "line STRING", sep="\u0001", quote="")
    return lines.select(
        F.col("line").alias(REJECTED), F.lit(0).alias(LAYOUT), F.input_file_name().alias(SOURCE)
    )


def read_routed(spark: SparkSession, found: Routed) -> DataFrame:
    """All rows of all groups, with what is rejected, as :func:`readers.read_reports` gives them."""
    frames = [read_group(spark, columns, files) for columns, files in sorted(found.groups.items())]
    if not frames:
        frames = [no_reports(spark)]
    if found.unknown:
        frames.append(read_unknown(spark, sorted(found.unknown)))
    return union_by_name(frames)


def read_reports_by_header(
    spark: SparkSession, folder: str, period: str = "*", *, rejects: bool = False
) -> DataFrame:
    """Daily reports of a period like :func:`readers.read_reports`, from files of any known layout.

    Times are as written, without a zone. Rows with another number of fields than
    their header are rejected; a bad value drops its row only when its column is used.
    """
    rows = read_files_by_header(spark, f"{folder}/{report_glob(period)}")
    return rows if rejects else readers.kept_rows(rows)


def read_files_by_header(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All rows of report files of any known layout, with what is rejected."""
    return read_routed(spark, routed(file_headers(spark, paths)))


def no_reports(spark: SparkSession) -> DataFrame:
    schema = schemas.DAILY_REPORT.replace(f"{STAMP} TIMESTAMP", f"{STAMP} TIMESTAMP_NTZ")
    return spark.createDataFrame([], f"{schema}, {REJECTED} STRING, {LAYOUT} INT, {SOURCE} STRING")


def unknown_headers(spark: SparkSession, found: Routed) -> DataFrame:
    """file and header of the files that no layout fits."""
    return spark.createDataFrame(sorted(found.unknown.items()), "file STRING, header STRING")
