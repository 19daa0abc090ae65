"""Answers for any range of months without a new aggregate.

An index is built once from a table by key and month. For every key and every
month from the first to the last it holds

* the sum of a value and the number of rows before the month and up to it, so the
  sum of a range is one difference of two rows of the index;
* the largest value of the 1, 2, 4, 8 ... months that begin there, so the largest of
  a range is that of two such spans that cover it.

A second index does the same for correlations: blocks of 1, 2, 4, 8 ... months hold
the number of pairs, both means and the sums of squared and cross deviations. A range
is a few blocks, whose states are merged around their common mean; nothing is
subtracted, so large values with small differences keep their digits.

Both are bounded by keys times months, however many rows they were made from.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.calendar import month_number, number_month
from tallyflow.functions.columns import named
from tallyflow.operators.filters import with_values
from tallyflow.session import staged

AT, START, END = "_at", "range_start", "range_end"


def month_bounds(df: DataFrame, month: str) -> tuple[int, int] | None:
    """Numbers of the first and the last month, or None without any."""
    first, last = df.agg(F.min(month_number(named(month))), F.max(month_number(named(month)))).first()
    return None if first is None else (first, last)


@dataclass(frozen=True)
class RangeIndex:
    """Sums and maxima of ``value`` per key of ``by``; make one with :func:`range_index`."""

    rows: DataFrame
    by: tuple[str, ...]
    value: str
    first: int
    last: int

    def ranges(self, asked: DataFrame) -> DataFrame:
        """Asked ranges (range_start, range_end as yyyy-MM) cut to the months of the index."""
        low = F.greatest(month_number(F.col(START)), F.lit(self.first))
        high = F.least(month_number(F.col(END)), F.lit(self.last))
        return asked.select(START, END, low.alias("_low"), high.alias("_high")).filter("_low <= _high")

    def all_ranges(self) -> DataFrame:
        """Every pair of a first and a last month."""
        spark = self.rows.sparkSession
        starts = spark.range(self.first, self.last + 1).select(F.col("id").cast("int").alias("s"))
        pairs = starts.select("s", F.explode(F.sequence("s", F.lit(self.last))).alias("e"))
        return pairs.select(number_month(F.col("s")).alias(START), number_month(F.col("e")).alias(END))

    def _ends(self, asked: DataFrame, columns: Sequence[str], second: Column, extra: Sequence[Column] = ()) -> DataFrame:
        """Both rows of the index that answer a range, as structs ``a`` and ``b``."""
        keys = [named(c) for c in self.by]
        a = self.rows.select(F.col(AT).alias("_low"), *keys, F.struct(*columns).alias("a"))
        b = self.rows.select(F.col(AT).alias("_second"), *keys, F.struct(*columns).alias("b"))
        wanted = self.ranges(asked).select("*", *extra).withColumn("_second", second)
        return wanted.join(a, "_low").join(b, ["_second", *self.by])

    def totals(self, asked: DataFrame) -> DataFrame:
        """Sum of the value per range and key; keys without a row in the range are left out."""
        found = self._ends(asked, ["before", "rows_before", "upto", "rows_upto"], F.col("_high"))
        return found.filter(F.col("b.rows_upto") > F.col("a.rows_before")).select(
            START, END, *[named(c) for c in self.by], (F.col("b.upto") - F.col("a.before")).alias(self.value)
        )

    def peaks(self, asked: DataFrame) -> DataFrame:
        """Largest value per range and key; keys without a row in the range are left out."""
        length = F.col("_high") - F.col("_low") + 1
        # The largest power of two that fits.
        level = F.length(F.bin(length)) - 1
        span = F.call_function("shiftleft", F.lit(1), F.col("_level"))
        found = self._ends(asked, ["peaks", "rows_before", "rows_of_span"], F.col("_high") - span + 1, [level.alias("_level")])
        a, b = F.col("a.peaks")[F.col("_level")], F.col("b.peaks")[F.col("_level")]
        some = F.col("a.rows_of_span")[F.col("_level")] + F.col("b.rows_of_span")[F.col("_level")] > 0
        return found.filter(some).select(START, END, *[named(c) for c in self.by], F.greatest(a, b).alias(self.value))


def range_index(df: DataFrame, by: Sequence[str], value: str, month: str = "month") -> RangeIndex:
    """Index of a table with a row, or several, per key and month; rows without a key are left out.

    It is written as a stage table: what is asked of it reads that table alone.
    """
    by = tuple(by)
    kept = with_values(df, [*by, month])
    bounds = month_bounds(kept, month) or (0, -1)
    first, last = bounds
    months = kept.groupBy(*[named(c) for c in by], month_number(named(month)).alias(AT)).agg(
        F.sum(named(value)).alias("v"), F.max(named(value)).alias("m"), F.count("*").alias("n")
    )
    calendar = F.explode(F.sequence(F.lit(first), F.lit(max(first, last)))).alias(AT)
    dense = months.select(*by).distinct().select(*by, calendar).join(months, [*by, AT], "left")
    window = Window.partitionBy(*by).orderBy(AT)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
    rows = dense.select(
        *by,
        AT,
        F.sum(v).over(upto).alias("upto"),
        F.sum(n).over(upto).alias("rows_upto"),
        v.alias("v"),
        n.alias("n"),
        F.col("m").alias("peak_0"),
        n.alias("span_0"),
    )
    levels = max(0, last - first).bit_length()
    for j in range(levels):
        # Twice as long: the span that begins here and the one that begins where it ends.
        ahead = {c: F.lead(f"{c}_{j}", 1 << j).over(window) for c in ("peak", "span")}
        rows = rows.withColumns(
            {
                f"peak_{j + 1}": F.greatest(F.col(f"peak_{j}"), ahead["peak"]),
                f"span_{j + 1}": F.col(f"span_{j}") + F.coalesce(ahead["span"], F.lit(0)),
            }
        )
    rows = rows.select(
        *by,
        AT,
        (F.col("upto") - F.col("v")).alias("before"),
        (F.col("rows_upto") - F.col("n")).alias("rows_before"),
        "upto",
        "rows_upto",
        F.array(*[f"peak_{j}" for j in range(levels + 1)]).alias("peaks"),
        F.array(*[f"span_{j}" for j in range(levels + 1)]).alias("rows_of_span"),
    )
    return RangeIndex(staged(rows, "range-index"), by, value, first, last)


# Number of pairs, means, sums of squared deviations and of products of deviations.
STATE = ("n", "mx", "my", "sx", "sy", "sxy")


def merged_state(a: Column, b: Column) -> Column:
    """State of two sets of pairs together; either may be empty."""
    n = a["n"] + b["n"]
    part = b["n"] / F.greatest(n, F.lit(1.0))
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    both = a["n"] * part
    merged = F.struct(
        n.alias("n"),
        (a["mx"] + dx * part).alias("mx"),
        (a["my"] + dy * part).alias("my"),
        (a["sx"] + b["sx"] + dx * dx * both).alias("sx"),
        (a["sy"] + b["sy"] + dy * dy * both).alias("sy"),
        (a["sxy"] + b["sxy"] + dx * dy * both).alias("sxy"),
    )
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(merged)


@dataclass(frozen=True)
class CorrelationIndex:
    """Co-moments of two columns per key in blocks of months; make one with :func:`correlation_index`."""

    rows: DataFrame
    by: tuple[str, ...]
    first: int
    last: int

    def blocks_of(self, asked: DataFrame) -> DataFrame:
        """The blocks that a range consists of, at most two of each length."""
        low = F.greatest(month_number(F.col(START)) - F.lit(self.first), F.lit(0))
        stop = F.least(month_number(F.col(END)), F.lit(self.last)) - F.lit(self.first) + 1
        ranges = asked.select(START, END, low.alias("l0"), stop.alias("r0"))
        picked = []
        levels = max(0, self.last - self.first).bit_length() + 1
        for j in range(levels):
            l, r = F.col(f"l{j}"), F.col(f"r{j}")  # noqa: E741
            odd_l, odd_r = (l < r) & (l % 2 == 1), (l < r) & (r % 2 == 1)
            # An odd start is the right half of a longer block, an odd stop follows a left half.
            picked += [F.when(odd_l, block(j, l)), F.when(odd_r & ~(odd_l & (l + 1 == r)), block(j, r - 1))]
            ranges = ranges.withColumns(
                {
                    f"l{j + 1}": F.floor((l + F.when(odd_l, 1).otherwise(0)) / 2).cast("int"),
                    f"r{j + 1}": F.floor((r - F.when(odd_r, 1).otherwise(0)) / 2).cast("int"),
                }
            )
        parts = F.explode(F.array_compact(F.array(*picked)))
        return ranges.select(START, END, parts.alias("part")).select(START, END, "part.level", "part.block")

    def correlations(self, asked: DataFrame, name: str = "r") -> DataFrame:
        """Correlation per range and key; NULL for fewer than two pairs or where a side does not vary.

        Keys without a pair in the range are left out.
        """
        found = self.blocks_of(asked).join(self.rows, ["level", "block"])
        # At most two blocks of each length, in an order that does not depend on the shuffle.
        item = F.struct("level", "block", "state")
        grouped = found.groupBy(START, END, *[named(c) for c in self.by]).agg(F.array_sort(F.collect_list(item)).alias("parts"))
        none = F.struct(*[F.lit(0.0).alias(c) for c in STATE])
        whole = F.aggregate("parts", none, lambda a, p: merged_state(a, p["state"]))
        spread = F.sqrt(F.col("s.sx")) * F.sqrt(F.col("s.sy"))
        r = F.when(F.col("s.n") >= 2, F.try_divide(F.col("s.sxy"), spread))
        # Rounding may pass the bounds; a missing r must not become one of them.
        r = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
        return grouped.withColumn("s", whole).select(START, END, *[named(c) for c in self.by], r.alias(name))


def block(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), number.cast("int").alias("block"))


def correlation_index(df: DataFrame, x: str, y: str, by: Sequence[str], month: str = "month") -> CorrelationIndex:
    """Co-moments of the rows that hold both values; written as a stage table."""
    by = tuple(by)
    pairs = with_values(df, [*by, month, x, y])
    first, last = month_bounds(pairs, month) or (0, -1)
    keys = [named(c) for c in by]
    # Deviations do not depend on where the zero is. Near the values, doubles are finest.
    least = pairs.groupBy(*keys).agg(F.min(named(x)).alias("_least_x"), F.min(named(y)).alias("_least_y"))
    pairs = pairs.join(staged(least, "least"), list(by))
    u, v = ((named(c) - F.col(f"_least_{k}")).cast("double") for c, k in ((x, "x"), (y, "y")))
    n = F.count("*").cast("double")
    leaves = pairs.groupBy(*keys, (month_number(named(month)) - F.lit(first)).alias("block")).agg(
        n.alias("n"),
        F.avg(u).alias("mx"),
        F.avg(v).alias("my"),
        (F.var_pop(u) * n).alias("sx"),
        (F.var_pop(v) * n).alias("sy"),
        (F.covar_pop(u, v) * n).alias("sxy"),
    )
    level = staged(leaves.select(*keys, F.lit(0).alias("level"), "block", F.struct(*STATE).alias("state")), "co-moments")
    found = [level]
    none = F.struct(*[F.lit(0.0).alias(c) for c in STATE])
    for j in range(1, max(0, last - first).bit_length() + 1):
        half = [F.coalesce(F.max(F.when(F.col("block") % 2 == side, F.col("state"))), none) for side in (0, 1)]
        pair = level.groupBy(*keys, F.floor(F.col("block") / 2).cast("int").alias("block")).agg(half[0].alias("a"), half[1].alias("b"))
        level = pair.select(*keys, F.lit(j).alias("level"), "block", merged_state(F.col("a"), F.col("b")).alias("state"))
        found.append(level)
    rows = staged(reduce(DataFrame.unionByName, found), "co-moments") if len(found) > 1 else level
    return CorrelationIndex(rows, by, first, last)
