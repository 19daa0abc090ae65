"""Column references by exact name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of that exact name, whatever characters it holds."""
    escaped = column.replace("`", "``")
    return F.col(f"`{escaped}`")
