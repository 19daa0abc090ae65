"""Aggregate expressions that stay NULL where a plain one would fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_pct(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; NULL when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole) * F.lit(100.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows that hold both values.

    NULL for fewer than two pairs or when either side does not vary.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), spread)
