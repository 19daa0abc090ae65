"""Column names and file layouts shared by readers, operators and results."""

from __future__ import annotations

from dataclasses import dataclass

# Names and layouts that existing input files and consumers of
# the results rely on.
MEASURES = ("Confirmed", "Deaths", "Recovered", "Active")

DAILY_REPORT = """
    FIPS STRING, Admin2 STRING, Province_State STRING, Country_Region STRING,
    Last_Update TIMESTAMP, Lat FLOAT, Long_ FLOAT,
    Confirmed INT, Deaths INT, Recovered INT, Active INT,
    Combined_Key STRING, Incident_Rate FLOAT, Case_Fatality_Ratio FLOAT
"""
DAILY_REPORT_12 = """
    FIPS STRING, Admin2 STRING, Province_State STRING, Country_Region STRING,
    Last_Update TIMESTAMP, Lat FLOAT, Long_ FLOAT,
    Confirmed INT, Deaths INT, Recovered INT, Active INT, Combined_Key STRING
"""
EARLIER_REPORT_NAMES = {
    "Latitude": "Lat",
    "Longitude": "Long_",
    "Incidence_Rate": "Incident_Rate",
}
REPORT_ESSENTIALS = ("Country_Region", "Last_Update", "Confirmed")
FACILITY_COLUMNS = ("icao", "country")
CODE_NAME_COLUMN = "English short name lower case"
CODE_COLUMN = "Alpha-2 code"
FLOW_COLUMNS = ("day", "origin", "destination")
MONTHLY_CASES = """
    year_month STRING, Country_Region STRING,
    Confirmed_cumulative DOUBLE, Deaths_cumulative DOUBLE,
    Recovered_cumulative DOUBLE, Active_cumulative DOUBLE,
    Confirmed_monthly_new DOUBLE, Deaths_monthly_new DOUBLE,
    Recovered_monthly_new DOUBLE, Active_monthly_new DOUBLE
"""
FLOW_COUNTS = """
    year_month STRING, origin_country STRING, origin_country_code STRING,
    destination_country STRING, destination_country_code STRING,
    flight_count LONG
"""
END_FLOWS = "month INT, end_country STRING, flights LONG"
WIDE_SERIES_PLACE = ("Province/State", "Lat", "Long")
WIDE_SERIES_AREA = "Country/Region"
WIDE_DATE_PATTERN = "M/d/yy"
AREA_ALIASES = {"US": "United States"}
DEFAULT_RANGE_END = "2020-08"
# End of the fixed values.

# Name of the column that holds the text of a malformed row, and of the one
# that holds the number of fields of the layout a row was read with.
REJECTED = "_rejected_line"
LAYOUT = "_layout"
# Name of the column with the file that a row came from.
SOURCE = "_source_file"


@dataclass(frozen=True)
class SnapshotSpec:
    """Roles of the columns in a table of cumulative snapshots.

    ``area`` is the key that survives the roll-up, ``stamp`` carries the time
    of the report (timestamp, timestamp_ntz or date) and ``measures`` are the
    running totals. Years outside ``first_year .. last_year`` (both included)
    are abnormal.
    """

    area: str = "Country_Region"
    stamp: str = "Last_Update"
    places: tuple[str, ...] = ("Admin2", "Province_State")
    measures: tuple[str, ...] = MEASURES
    first_year: int = 2020
    last_year: int = 2024

    @property
    def cumulative(self) -> list[str]:
        return [f"{m}_cumulative" for m in self.measures]

    @property
    def daily_new(self) -> list[str]:
        return [f"{m}_daily_new" for m in self.measures]

    @property
    def monthly_new(self) -> list[str]:
        return [f"{m}_monthly_new" for m in self.measures]

    @property
    def month_stats(self) -> list[str]:
        return self.cumulative + self.monthly_new
