"""Candidates for names that another table does not know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.columns import named

GRAM = 2
# Edits that a candidate may be away, as a share of the longer of both names; two, an
# exchange of neighbours, are always allowed from four letters on.
MOST_EDITS = 0.25


def plain_name(name: Column) -> Column:
    """Letters and digits in lower case, words sorted: ``Korea, Republic of`` and ``Republic of Korea`` are one."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(words), " ")


def grams(name: Column) -> Column:
    """Overlapping pieces of a name with its ends marked; the second of equal ones is another gram."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda i: F.substr(padded, i, F.lit(GRAM)))
    return F.transform(pieces, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pieces, F.lit(1), i), lambda x: x == p)).cast("string")))


def edits_allowed(length: Column) -> Column:
    few = F.least(F.floor(length / 2), F.lit(2))
    return F.greatest(F.floor(length * MOST_EDITS), few, F.lit(1)).cast("int")


def name_candidates(
    names: DataFrame, name: str, known: DataFrame, known_name: str, best: int = 1
) -> DataFrame:
    """name, candidate, score and rank: the known names that are fewest edits away.

    An edit changes at most two of a name's grams of two letters. So if two names
    are at most k edits apart, and the grams of both are put in one order, they have
    one of the first 2k + 1 grams of each in common. Only pairs that share such a
    gram are compared, and the order puts rare grams first, so there is no table of
    all pairs and no pair within k edits is missed. k is a quarter of the
    longer name's length, or 2. The score is 1 less edits by that length, and above 0;
    names without a letter or digit have no candidate.
    """
    sides = {"names": (names, name), "known": (known, known_name)}
    plain = {}
    for side, (df, column) in sides.items():
        distinct = df.filter(named(column).isNotNull()).select(named(column).alias("name")).distinct()
        plain[side] = distinct.withColumn("plain", plain_name(F.col("name"))).filter("plain <> ''")
    # A candidate may be longer than the name by as many letters as edits are allowed.
    length = F.length("plain")
    longest = F.greatest(F.ceil(length / F.lit(1 - MOST_EDITS)).cast("int"), length + 2)
    taken = {
        side: df.select("plain").distinct().select("plain", edits_allowed(longest).alias("edits"), F.posexplode(grams(F.col("plain"))).alias("at", "gram"))
        for side, df in plain.items()
    }
    counts = taken["known"].unionByName(taken["names"]).groupBy("gram").agg(F.count("*").alias("rows_of_gram"))
    order = Window.partitionBy("plain").orderBy("rows_of_gram", "gram")
    first = {
        side: df.join(counts, "gram").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= GRAM * F.col("edits") + 1)
        for side, df in taken.items()
    }
    left = first["names"].select(F.col("plain").alias("a"), "gram")
    right = first["known"].select(F.col("plain").alias("b"), "gram")
    distance, longer = F.levenshtein("a", "b"), F.greatest(F.length("a"), F.length("b"))
    close = (
        left.join(right, "gram")
        .select("a", "b")
        .distinct()
        .withColumns({"edits": distance, "longer": longer})
        .filter((F.col("edits") <= edits_allowed(F.col("longer"))) & (F.col("edits") < F.col("longer")))
    )
    scored = (
        close.join(plain["names"].select(F.col("name").alias(name), F.col("plain").alias("a")), "a")
        .join(plain["known"].select(F.col("name").alias("candidate"), F.col("plain").alias("b")), "b")
        .withColumn("score", F.lit(1.0) - F.col("edits") / F.col("longer"))
    )
    ranked = Window.partitionBy(named(name)).orderBy(F.col("score").desc(), "candidate")
    return (
        scored.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= best)
        .select(named(name), "candidate", "score", "rank")
    )


def recall(found: DataFrame, truth: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: the share of the pairs in ``truth`` that were found."""
    hit = truth.join(found.select(*on).distinct().withColumn("_hit", F.lit(1)), list(on), "left")
    return hit.agg((F.count("_hit") / F.count("*")).alias("recall"))
