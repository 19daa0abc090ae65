"""What the corpus operators add to the entry points."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyflow.llm import queries


def importable(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Lets Python workers find this package where the driver found it.

    A cluster gets the package with the job (``--py-files``); a session that was
    started from another folder, as in local mode, would not look here.
    """
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.sparkContext.environment
        paths = known.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            known["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, root) if p)
        return query(spark, sf_dir)

    return run


def corpus_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
    return {name: importable(query) for name, query in found.items()}


def corpus_sql() -> dict[str, str]:
    sql = dict(queries.SQL)
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
