"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.session import staged


def components(links: DataFrame) -> DataFrame:
    """row and label (smallest row of its component) for every row in ``links`` (a, b).

    Each round gives a row the smallest label among itself and its neighbours,
    then the label of that label, until nothing changes. Every round is a written
    table, so a lost executor costs one round at most.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.filter("a != b").distinct(), "both-ways")
    labels = staged(both.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("row", "b"), "b")
            .groupBy(F.col("a").alias("row"))
            .agg(F.min("label").alias("near"))
        )
        jump = labels.select(F.col("row").alias("label"), F.col("label").alias("jump"))
        moved = labels.join(near, "row").join(jump, "label")
        new = staged(
            moved.select("row", F.least("label", "near", "jump").alias("label"), (F.least("near", "jump") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = new.select("row", "label")
        if new.filter("moved").isEmpty():
            return labels
