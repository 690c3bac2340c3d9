"""Date parsing and differences. No function reads the clock; pass ``as_of`` instead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import _col, trim_spaces

# month/day/year, alone or with a 24-hour or a 12-hour time.
DATE_SHAPE = (
    r"(?i)^\d{1,2}/\d{1,2}/\d{4}"
    r"( ([01]?\d|2[0-3]):[0-5]\d| (0?[1-9]|1[0-2]):[0-5]\d:[0-5]\d [AP]M)?$"
)
DAYS_PER_YEAR = 365.25


def parse_date(c: Column | str) -> Column:
    """Date of a text in one of the known spellings; NULL when none fits or the day does not exist.

    The shape is checked by one pattern and the day read once, as year-month-day. Trying one format after
    the other would raise and catch an exception per row and miss.
    """
    text = trim_spaces(c)
    day = F.substring_index(text, " ", 1)
    month, year = F.substring_index(day, "/", 1), F.substring_index(day, "/", -1)
    number = F.substring_index(F.substring_index(day, "/", 2), "/", -1)
    return F.when(text.rlike(DATE_SHAPE), F.concat_ws("-", year, month, number)).try_cast("date")


def year_of(c: Column | str) -> Column:
    return F.year(_col(c)).cast("bigint")


def days_between(start: Column | str, end: Column | str) -> Column:
    """end - start in days; negative when the end comes first, NULL when either is missing."""
    return F.datediff(_col(end), _col(start)).cast("bigint")


def years_from_days(days: Column | str) -> Column:
    return _col(days).cast("double") / F.lit(DAYS_PER_YEAR)
