"""Batch identifiers: ``YYYYMM``, ``YYYY`` or ``*``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_parts(period: str) -> tuple[str, str]:
    """Year and month of a batch identifier, ``*`` for an open part."""
    if period == "*":
        return "*", "*"
    found = re.fullmatch(r"(\d{4})(\d{2})?", period)
    if not found:
        raise ValueError(f"a period is YYYYMM, YYYY or *, not {period!r}")
    return found.group(1), found.group(2) or "*"


def report_glob(period: str, prefix: str = "", suffix: str = ".csv") -> str:
    """Glob of daily report files, named ``MM-DD-YYYY`` or ``YYYY-MM-DD``."""
    year, month = period_parts(period)
    # An open part is one to four digits wide, so that each file matches one
    # of the two forms only.
    year_form = "[0-9][0-9][0-9][0-9]" if year == "*" else year
    month_form = "[0-9][0-9]" if month == "*" else month
    day_form = "[0-9][0-9]"
    american = f"{month_form}-{day_form}-{year_form}"
    iso = f"{year_form}-{month_form}-{day_form}"
    return f"{prefix}{{{american},{iso}}}{suffix}"


def flow_glob(period: str, prefix: str = "flightlist_", suffix: str = ".csv.gz") -> str:
    """Glob of flow files, named by the first and last day they cover."""
    stem = "" if period == "*" else "".join(p for p in period_parts(period) if p != "*")
    return f"{prefix}{stem}*_{stem}*{suffix}"


def report_day(file: Column) -> Column:
    """The day in the name of a report file, ``MM-DD-YYYY`` or ``YYYY-MM-DD``; NULL without one.

    The last such name of a path counts, so a folder written in place of a file will do.
    """
    # Tied to the start: a path without such a name is gone through once, not again from each of its letters.
    american = F.regexp_extract(file, r"^.*/(\d{2}-\d{2}-\d{4})[.]csv", 1)
    iso = F.regexp_extract(file, r"^.*/(\d{4}-\d{2}-\d{2})[.]csv", 1)
    swapped = F.regexp_replace(american, r"^(\d{2}-\d{2})-(\d{4})$", "$2-$1")
    return F.coalesce(F.nullif(iso, F.lit("")), swapped).try_cast("date")
