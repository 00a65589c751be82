"""Date normalisation for scoring and for page linkage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .blanks import squeeze

# Fixed patterns.
YEAR_FIRST = r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$"
YEAR_FIRST_PADDED = r"^(\d{4})[/.\-](\d{2})[/.\-](\d{2})$"
YEAR_LAST = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$"
DATE_FRAGMENT = r"^\d{1,2}[/.\-]\d{1,2}([/.\-]\d{2,4})?$"
CALENDAR_YEAR = r"\b(19\d{2}|20\d{2})\b"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def normalize_date(value: Column, order: str = "DMY") -> Column:
    """``YYYY-MM-DD`` where the text is a date, else the lower-cased text.

    A first part above 12 can only be a day, a second part above 12 only a day;
    the configured order settles the rest.
    """

    def date(text: Column) -> Column:
        return _date(text, order)

    # The lambda binds the text, so that its branches don't squeeze it anew.
    return F.get(F.transform(F.array(squeeze(value.cast("string"))), date), F.lit(0))


def _date(text: Column, order: str) -> Column:
    first, second, year = (_part(text, YEAR_LAST, i) for i in (1, 2, 3))
    a, b = first.cast("int"), second.cast("int")
    month_first = (a <= 12) & ((b > 12) | F.lit(order.strip().upper() == "MDY"))
    month = F.when(month_first, first).otherwise(second)
    day = F.when(month_first, second).otherwise(first)
    in_range = month.cast("int").between(1, 12) & day.cast("int").between(1, 31)
    return (
        F.when(text == "", None)
        .when(text.rlike(YEAR_FIRST), _iso(*(_part(text, YEAR_FIRST, i) for i in (1, 2, 3))))
        .when(text.rlike(YEAR_LAST), F.when(in_range, _iso(year, month, day)).otherwise(F.lower(text)))
        .otherwise(F.lower(text))
    )


def date_token(value: Column) -> Column:
    """Linkage key of a date: fixed day-first or padded ISO order."""
    text = squeeze(value.cast("string"))
    return (
        F.when(text.rlike(YEAR_LAST), _iso(*(_part(text, YEAR_LAST, i) for i in (3, 2, 1))))
        .when(text.rlike(YEAR_FIRST_PADDED), _iso(*(_part(text, YEAR_FIRST_PADDED, i) for i in (1, 2, 3))))
        .otherwise(F.lower(text))
    )


def is_date_fragment(value: Column) -> Column:
    return squeeze(value.cast("string")).rlike(DATE_FRAGMENT)


def years_in(value: Column) -> Column:
    """Distinct calendar years mentioned in the text."""
    return F.array_distinct(F.regexp_extract_all(value.cast("string"), F.lit(CALENDAR_YEAR), F.lit(1)))


def parse_iso_utc(value: Column) -> Column:
    """ISO instant (``Z`` or offset, naive means UTC); unreadable text is null."""
    text = squeeze(value.cast("string"))
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def epoch_seconds(local_time: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, local_time.cast("timestamp_ntz"))
