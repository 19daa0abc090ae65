"""Session defaults, and the shared folder for stage tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "tallyflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with UTC time and adaptive execution.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where the
    submit command and AQE choose them. Call-site capture is off: it costs the
    driver some milliseconds per expression, which adds up in a long plan.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as named by ``spark.checkpoint.dir``.

    Only a local session may do without: its executor is the driver's process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        require_local(spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyflow-"))
    return spark.sparkContext.getCheckpointDir()


def require_local(master: str) -> None:
    if not master.split("[")[0] == "local":
        raise ValueError(f"name a shared folder in spark.checkpoint.dir for {master}")


def stage_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A new path in the shared folder or in ``folder``, never used before."""
    return f"{(folder or shared_folder(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of stages on whatever storage it is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def swap_path(spark: SparkSession, new: str, path: str) -> None:
    """Puts the folder ``new`` in the place of ``path``, which is there until the last moment.

    Two renames; if the second fails the old folder goes back. What a run that was killed
    between them left aside is put back by :func:`restore_path`.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    source, target, aside = jvm_path(new), jvm_path(path), jvm_path(aside_of(path))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    old = files.exists(target)
    if old:
        files.delete(aside, True)
        files.rename(target, aside)
    if not files.rename(source, target):
        if old:
            files.rename(aside, target)
        raise OSError(f"cannot rename {new} to {path}")
    if old:
        files.delete(aside, True)


def restore_path(spark: SparkSession, path: str) -> None:
    """Puts back the folder that a swap was killed over, if there is one and nothing in its place."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = jvm_path(path), jvm_path(aside_of(path))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(aside) and not files.exists(target):
        files.rename(aside, target)


def aside_of(path: str) -> str:
    """A place beside a folder that readers of its parent pass over."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    return f"{parent}/_aside-{name}"


def staged(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Writes a table to the shared folder, or to ``folder``, and reads it back.

    What follows starts from the written table: its input is scanned once,
    and a lost executor costs no second scan.
    """
    spark = df.sparkSession
    path = stage_path(spark, label, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
