"""Change from one period to the next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.columns import named
from tallyflow.operators.filters import require_one_of

GAPS = ("keep", "carry", "spread")
RESETS = ("keep", "carry")
REPORTED = "reported"


def step_changes(df: DataFrame, by: str, order: str, changes: Mapping[str, str]) -> DataFrame:
    """Adds ``new = value - previous value`` within ``by``, in order.

    ``changes`` maps each new column to the column it is taken from. All share
    one window, so there is one sort. The input is expected to be rolled up to
    one row per ``by`` and ``order`` value, which bounds a window partition by
    the number of periods, however many raw rows an area has.
    """
    window = Window.partitionBy(named(by)).orderBy(named(order))
    return df.withColumns(
        {new: named(old) - F.lag(named(old)).over(window) for new, old in changes.items()}
    )


def filled_days(
    df: DataFrame, by: str, day: str, values: Sequence[str], gaps: str = "carry"
) -> DataFrame:
    """A row for each day between the first and the last of each ``by``, with running totals.

    On a day without a value ``carry`` keeps the last known total, so the next
    report brings the whole change; ``spread`` lets the total move evenly, in whole
    numbers, from the last known one to the next. Either way changes add up to the
    last total minus the first. Before the first and after the last known value of
    a column there is nothing to spread: it is NULL, or stays as it was last.
    ``reported`` tells days with a row from those that were filled in.

    Each row makes the empty days up to the next one itself, so there is no join
    with a calendar, and one shuffle for all windows. Expects one row per ``by``
    and day; rows without a day are left out.
    """
    require_one_of("gaps", gaps, GAPS[1:])
    window = Window.partitionBy(named(by)).orderBy(named(day))
    known = df.filter(named(day).isNotNull())
    until = F.coalesce(F.date_sub(F.lead(named(day)).over(window), 1), named(day))
    others = [named(c) for c in df.columns if c not in (day, *values)]
    rows = known.withColumn("_own", named(day)).withColumn("_until", until)
    rows = rows.select("*", F.explode(F.sequence(named(day), F.col("_until"))).alias("_day"))
    own = F.col("_own") == F.col("_day")
    rows = rows.select(
        *others,
        F.col("_day").alias(day),
        own.alias(REPORTED),
        *[F.when(own, named(v)).alias(v) for v in values],
    )
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    # From the end, as Spark works a frame to the end of a partition out anew for each row.
    to_come = Window.partitionBy(named(by)).orderBy(named(day).desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = {v: F.when(named(v).isNotNull(), F.struct(named(day).alias("day"), named(v).alias("value"))) for v in values}
    rows = rows.withColumns({f"_last_{i}": F.last(at[v], ignorenulls=True).over(so_far) for i, v in enumerate(values)})
    if gaps == "spread":
        rows = rows.withColumns({f"_next_{i}": F.last(at[v], ignorenulls=True).over(to_come) for i, v in enumerate(values)})
    kinds = dict(df.dtypes)
    filled = [total_between(i, day, gaps).cast(kinds[v]).alias(v) for i, v in enumerate(values)]
    order = {c: i for i, c in enumerate(df.columns)}
    columns = sorted([*[(order[c], named(c)) for c in df.columns if c not in values], *[(order[v], f) for v, f in zip(values, filled)]], key=lambda x: x[0])
    return rows.select(*[c for _, c in columns], REPORTED)


def total_between(i: int, day: str, gaps: str) -> Column:
    """The total of a day from the known ones on both sides."""
    before = F.col(f"_last_{i}")
    if gaps == "carry":
        return before["value"]
    after = F.col(f"_next_{i}")
    passed = F.datediff(named(day), before["day"]).cast("long")
    length = F.greatest(F.datediff(after["day"], before["day"]), F.lit(1)).cast("long")
    moved = F.call_function("div", (after["value"] - before["value"]).cast("long") * passed, length)
    return F.coalesce(before["value"] + moved, before["value"])


def carried_resets(
    df: DataFrame, by: str, order: str, values: Sequence[str]
) -> DataFrame:
    """Running totals that never fall: each drop within ``by`` is added to all later values.

    A total that falls, because its counter began anew or a number was taken back,
    goes on from where it was, so its change on that day is 0 and no later change is
    negative. ``_drop_`` columns hold the drops; see :func:`reset_events`.
    NULL values stay NULL, and the value after them is compared with the one before.
    Expects one row per ``by`` and ``order`` value.
    """
    window = Window.partitionBy(named(by)).orderBy(named(order))
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    drops = {
        f"_drop_{v}": F.greatest(F.last(named(v), ignorenulls=True).over(earlier) - named(v), F.lit(0))
        for v in values
    }
    known = df.withColumns(drops)
    offsets = {v: named(v) + F.sum(F.coalesce(named(f"_drop_{v}"), F.lit(0))).over(so_far) for v in values}
    kinds = dict(df.dtypes)
    return known.withColumns({v: total.cast(kinds[v]) for v, total in offsets.items()})


def reset_events(df: DataFrame, by: str, order: str, values: Sequence[str]) -> DataFrame:
    """by, order, measure and drop of each fall, from the result of :func:`carried_resets`."""
    drops = [F.struct(F.lit(v).alias("measure"), named(f"_drop_{v}").cast("long").alias("drop")) for v in values]
    rows = df.select(named(by), named(order), F.explode(F.array(*drops)).alias("event"))
    return rows.select(named(by), named(order), "event.measure", "event.drop").filter("drop > 0")


def without_drops(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_drop_")])
