"""Labels and result names."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_label(stat: Column) -> Column:
    """``Confirmed_monthly_new`` becomes ``Confirmed Monthly New``."""
    return F.initcap(F.replace(stat, F.lit("_"), F.lit(" ")))


def monthly_name(stat: Column) -> Column:
    """Name of the monthly change that belongs to a cumulative stat."""
    return F.regexp_replace(stat, "_cumulative$", "_monthly_new")


def slug(parts: Column) -> Column:
    """Joins an array of names into one that is safe in a path."""
    joined = F.array_join(parts, "__")
    return F.replace(F.replace(joined, F.lit(" "), F.lit("_")), F.lit("*"), F.lit("all"))


def areas_label(areas: Iterable[str] | None) -> str:
    """Name of the partition for a choice of areas; ``all`` when none is chosen.

    The order of the choice does not matter, and two choices never share a name:
    names are percent-encoded, so none of them can hold the comma that joins them.
    """
    chosen = sorted({quote(a, safe=" ") for a in areas or []})
    if not chosen:
        return "all"
    return "%61ll" if chosen == ["all"] else ",".join(chosen)


def all_digits(name: Column) -> Column:
    """True for a name made of digits alone; false for NULL."""
    return F.coalesce(name.rlike("^[0-9]+$"), F.lit(False))
