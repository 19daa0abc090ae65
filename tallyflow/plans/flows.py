"""Flow records mapped to countries, and counted by country pair."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.calendar import month_text, utc_day
from tallyflow.functions.columns import named
from tallyflow.operators.filters import among, require_one_of, with_values
from tallyflow.operators.lookups import attach, splittable, unique_by

DIRECTIONS = ("origin", "destination")
PERIODS = ("day", "year_month")
WEIGHT = "flights"
COMPLETE = ("day", "origin_country", "destination_country")


def spread_rows(flows: DataFrame) -> DataFrame:
    """Raw flows dealt over the cluster before the lookups, as a gzip file is one task.

    Days travel as dates, a fifth of their text. Rows are dealt by their values: in turn
    would need a sort of each file first, so that a task run again deals them alike.
    """
    return flows.withColumn("day", utc_day(flows, "day")).hint("rebalance", "day", *DIRECTIONS)


def pair_counts(flows: DataFrame) -> DataFrame:
    """Flows per day and pair of facilities.

    For facilities too many to broadcast: where flows repeat a pair of the
    same day, this takes the bulk and the skew of a busy facility away before
    the lookups have to shuffle.
    """
    return flows.groupBy(
        utc_day(flows, "day").alias("day"), "origin", "destination"
    ).agg(F.count("*").alias(WEIGHT))


def map_flows(
    flows: DataFrame,
    places: DataFrame,
    destination_places: DataFrame | None = None,
    *,
    keep_incomplete: bool = False,
    spread: int = 1,
) -> DataFrame:
    """Adds country code and name at both ends, and the month.

    Takes raw flows or pair counts. Rows without a day or without a known
    country at either end are dropped, unless ``keep_incomplete`` is set for
    a profile of what is missing.
    """
    dimensions = {"origin": places, "destination": destination_places or places}
    mapped = flows.withColumn("day", utc_day(flows, "day"))
    for end, dimension in dimensions.items():
        mapped = attach(
            mapped,
            end,
            dimension,
            "icao",
            {
                "icao": f"{end}_icao",
                "country_code": f"{end}_country_code",
                "country": f"{end}_country",
            },
            spread,
        )
    mapped = mapped.drop(*DIRECTIONS).withColumn("year_month", month_text(F.col("day")))
    if keep_incomplete:
        return mapped
    return with_values(mapped, COMPLETE)


def month_totals(mapped: DataFrame) -> DataFrame:
    """Mapped flows, incomplete ones included, counted per month and ends.

    Bounded by months and pairs of countries, and enough for both the monthly
    counts and the profile of what is missing. A facility is reduced to
    whether it is known.
    """
    ends = [f"{end}_{part}" for end in DIRECTIONS for part in ("country_code", "country")]
    known = {
        f"{end}_icao": F.when(F.col(f"{end}_icao").isNotNull(), F.lit(True)) for end in DIRECTIONS
    }
    return (
        mapped.select(
            F.trunc("day", "month").alias("day"),
            *ends,
            *[flag.alias(name) for name, flag in known.items()],
        )
        .groupBy("day", *ends, *known)
        .agg(F.count("*").alias(WEIGHT))
        .withColumn("year_month", month_text(F.col("day")))
    )


def count_flows(
    mapped: DataFrame,
    direction: str = "origin",
    granular: str = "day",
    countries: Iterable[str] | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """International flows per period and pair of countries, from mapped flows.

    ``countries`` restricts the end named by ``direction``; ``extra`` columns
    join the key.
    """
    require_one_of("direction", direction, DIRECTIONS)
    require_one_of("granular", granular, PERIODS)
    abroad = among(mapped, f"{direction}_country", countries).filter(
        F.col("origin_country_code") != F.col("destination_country_code")
    )
    count = F.sum(named(WEIGHT)) if WEIGHT in mapped.columns else F.count("*")
    if granular == "year_month":
        # A date is cheaper to group by than the text, which is made at the end.
        abroad = abroad.withColumn(granular, F.trunc("day", "month"))
    counts = abroad.groupBy(
        granular,
        "origin_country",
        "origin_country_code",
        "destination_country",
        "destination_country_code",
        *extra,
    ).agg(count.alias("flight_count"))
    if granular == "year_month":
        counts = counts.withColumn(granular, month_text(named(granular)))
    return counts


def country_pair_counts(
    flows: DataFrame,
    facilities: DataFrame,
    codes: DataFrame,
    direction: str = "origin",
    granular: str = "day",
    countries: Iterable[str] | None = None,
    destination_facilities: DataFrame | None = None,
) -> DataFrame:
    """The result of :func:`count_flows` straight from raw flows or pair counts.

    The plan for large inputs. Facilities are first cut down to those in a
    known, and where asked for chosen, country, so the two lookups are inner
    joins that drop all other flows early, those without a facility before any
    shuffle. Flows are grouped by date and code; names and the text of the
    month are added to the small result.
    """
    require_one_of("direction", direction, DIRECTIONS)
    require_one_of("granular", granular, PERIODS)
    known = unique_by(codes, "country_code", "country")
    day = utc_day(flows, "day")
    period = F.trunc(day, "month") if granular == "year_month" else day
    weight = [WEIGHT] if WEIGHT in flows.columns else []
    coded = flows.select(period.alias("period"), *DIRECTIONS, *weight).filter(
        F.col("period").isNotNull()
    )
    names = {}
    for end in DIRECTIONS:
        names[end] = among(known, "country", countries if end == direction else None).filter(
            F.col("country").isNotNull()
        )
        table = facilities
        if end == "destination" and destination_facilities is not None:
            table = destination_facilities
        placed = (
            unique_by(table, "icao", "country")
            .withColumnsRenamed({"icao": end, "country": "country_code"})
            .join(names[end].select("country_code"), "country_code", "left_semi")
            .withColumnRenamed("country_code", f"{end}_country_code")
        )
        coded = coded.join(splittable(placed), end).drop(end)
    counts = (
        coded.filter(F.col("origin_country_code") != F.col("destination_country_code"))
        .groupBy("period", "origin_country_code", "destination_country_code")
        .agg((F.sum(WEIGHT) if weight else F.count("*")).alias("flight_count"))
    )
    for end in DIRECTIONS:
        labels = {"country_code": f"{end}_country_code", "country": f"{end}_country"}
        counts = counts.join(names[end].withColumnsRenamed(labels), f"{end}_country_code")
    shown = month_text(F.col("period")) if granular == "year_month" else F.col("period")
    return counts.select(
        shown.alias(granular),
        "origin_country",
        "origin_country_code",
        "destination_country",
        "destination_country_code",
        "flight_count",
    )


def flow_order(direction: str, granular: str) -> list[str]:
    """Sort columns of a flow result: the chosen end, the other end, time."""
    require_one_of("direction", direction, DIRECTIONS)
    other = DIRECTIONS[1 - DIRECTIONS.index(direction)]
    return [f"{direction}_country_code", f"{other}_country_code", granular]
