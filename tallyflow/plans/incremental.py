"""Day totals that are kept up to date by reading the files that changed.

A store holds three datasets, each with a directory per run:

* ``partials``: sums per file, day and area of the files a run has read;
* ``totals``: sums per day and area of all files as they were then;
* ``ledger``: the files of that moment with size and time, and the run whose
  partials hold them. It is written last, so a run without it does not count
  and is written over by the next one.

A run lists the input files (no file is opened for that), compares the list with
the ledger, reads new and changed files, adds what they hold to the totals and
takes away what the ledger's version of changed and deleted files held. Sums and
numbers of values can be added and subtracted, which is all a total consists of.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.columns import named
from tallyflow.operators.rollups import ROWS, day_states, merged_states, negated_states, totals_of_states
from tallyflow.schemas import SOURCE, SnapshotSpec
from tallyflow.session import drop_path, staged

RUN, FILE, SIZE, TIME, HELD, NOTE = "run", "file", "size", "changed_at", "held_in", "note"
LEDGER = f"{FILE} STRING, {SIZE} LONG, {TIME} TIMESTAMP, {HELD} LONG, {NOTE} STRING, {RUN} LONG"


@dataclass(frozen=True)
class Refreshed:
    """The totals after a run, its number, how many files it read and took away, and notes on files."""

    totals: DataFrame
    run: int
    read: int
    taken_away: int
    notes: DataFrame


def one_name(path: Column) -> Column:
    """A local path has one to three slashes, depending on which of Spark's columns tells it."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def one_slash(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """file, size and changed_at of all files below a glob; none is opened."""
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{FILE} STRING, {SIZE} LONG, {TIME} TIMESTAMP")
    found = files.metadataColumn("_metadata")
    return files.select(
        one_name(found["file_path"]).alias(FILE),
        F.col("length").alias(SIZE),
        F.col("modificationTime").alias(TIME),
    )


def current_ledger(spark: SparkSession, store: str) -> tuple[int, DataFrame]:
    """Number and files of the last run, 0 and none before the first."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, spark.createDataFrame([], LEDGER)
    # Each run has a row without a file, so that one without any file counts too.
    run = rows.agg(F.max(RUN)).first()[0] or 0
    return run, rows.filter((F.col(RUN) == run) & F.col(FILE).isNotNull())


def refresh_totals(
    spark: SparkSession,
    inputs: str,
    store: str,
    read: Callable[[Sequence[str]], DataFrame],
    spec: SnapshotSpec = SnapshotSpec(),
    notes: Callable[[], Mapping[str, str]] = dict,
) -> Refreshed:
    """Day totals of all files below the glob ``inputs``, of which only changed ones are read.

    ``read`` gives the reports of a list of files, with ``_source_file`` and, where the
    scan keeps them, rejected lines. ``notes`` is asked after that for what there is to
    say about some of them, which the ledger keeps with the file. One run at a time may
    work on a store.
    """
    last, ledger = current_ledger(spark, store)
    run = last + 1
    files = staged(input_files(spark, inputs), "input-files")
    same = [FILE, SIZE, TIME]
    changed = files.join(ledger, same, "left_anti")
    gone = ledger.join(files, same, "left_anti").select(FILE, HELD)
    # A list of the files to read, as Spark itself keeps one for each read.
    names = [r[FILE] for r in changed.select(FILE).collect()]
    taken_away = gone.count()
    if last and not names and not taken_away:
        return Refreshed(read_totals(spark, store, last, spec), last, 0, 0, noted(ledger))

    states = [state_frame(spark, f"{store}/totals", spec, last)] if last else []
    path = f"{store}/partials/{RUN}={run}"
    fresh = day_states(read([unquote(n) for n in sorted(names)]), spec, extra=[SOURCE]) if names else no_states(spark, spec)
    fresh.withColumn(FILE, one_name(named(SOURCE))).drop(SOURCE).write.mode("overwrite").parquet(path)
    written = spark.read.schema(state_schema(spec, f"{FILE} STRING")).parquet(path)
    states.append(written.drop(FILE))
    if taken_away:
        held = spark.read.schema(state_schema(spec, f"{FILE} STRING, {RUN} LONG")).parquet(f"{store}/partials")
        # Only the directories of those runs are read.
        was = held.withColumnRenamed(RUN, HELD).join(gone, [FILE, HELD]).drop(FILE, HELD)
        states.append(negated_states(was, spec))
    totals = states[0]
    for more in states[1:]:
        totals = totals.unionByName(more)
    merged_states(totals, ["date", spec.area], spec).write.mode("overwrite").parquet(f"{store}/totals/{RUN}={run}")
    kept = ledger.join(files, same, "left_semi").select(*same, HELD, NOTE)
    mark = spark.createDataFrame([(None,) * 5], LEDGER.rsplit(",", 1)[0])
    said = {one_slash(path): note for path, note in notes().items()}
    of_file = spark.createDataFrame([(n, said[unquote(n)]) for n in names if unquote(n) in said], f"{FILE} STRING, {NOTE} STRING")
    new = changed.join(of_file, FILE, "left").select(*same, F.lit(run).cast("long").alias(HELD), NOTE)
    kept.unionByName(new).unionByName(mark).write.mode("overwrite").parquet(f"{store}/ledger/{RUN}={run}")
    for old in ("totals", "ledger"):  # a reader of the run before may still be at work
        drop_path(spark, f"{store}/{old}/{RUN}={run - 2}")
    return Refreshed(read_totals(spark, store, run, spec), run, len(names), taken_away, noted(current_ledger(spark, store)[1]))


def noted(ledger: DataFrame) -> DataFrame:
    """file and note of the files that there is something to say about."""
    return ledger.filter(F.col(NOTE).isNotNull()).select(FILE, NOTE)


def state_schema(spec: SnapshotSpec, extra: str = "") -> str:
    kinds = [f"`{m}` LONG, `{m}_values` LONG" for m in spec.measures]
    return ", ".join([x for x in (extra, "date DATE", f"`{spec.area}` STRING", *kinds, f"{ROWS} LONG", "rejected_rows LONG") if x])


def no_states(spark: SparkSession, spec: SnapshotSpec) -> DataFrame:
    return spark.createDataFrame([], state_schema(spec, f"{SOURCE} STRING"))


def state_frame(spark: SparkSession, path: str, spec: SnapshotSpec, run: int) -> DataFrame:
    return spark.read.schema(state_schema(spec)).parquet(f"{path}/{RUN}={run}")


def read_totals(spark: SparkSession, store: str, run: int, spec: SnapshotSpec) -> DataFrame:
    """The totals of a run as :func:`tallyflow.operators.rollups.area_day_totals` gives them."""
    return totals_of_states(state_frame(spark, f"{store}/totals", spec, run), spec)
