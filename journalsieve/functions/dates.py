"""Date text to timestamp, and month arithmetic.

Timestamps carry no time zone (``timestamp_ntz``), so day gaps do not move with daylight saving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from journalsieve.functions.text import strip

# day.month.year with optional time, day.month with two-digit year, and the ISO shape of both
_GERMAN = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?= |$)"
_GERMAN_SHORT = r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$"
_GERMAN_MINUTES = r"^(\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{1,2})$"
_ISO = r"^(\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{1,2}:\d{1,2}(?=(?:\.\d{1,6})?$)|$))"
# fixed values: the span a nanosecond timestamp can hold; dates outside it count as missing
_EARLIEST, _LATEST = "1677-09-22", "2262-04-11"


def _stamp(c: Column) -> Column:
    """Every accepted shape is rewritten to ISO order and goes through one cast; no row pays for a
    chain of failing format parsers.  Each step uses the one before it once."""
    text = F.regexp_replace(strip(c), _GERMAN_MINUTES, "$1:00")
    text = F.regexp_replace(text, _GERMAN, "$3-$2-$1")
    text = F.regexp_replace(text, _GERMAN_SHORT, "20$3-$2-$1")
    return F.regexp_extract(text, _ISO, 1).try_cast("timestamp_ntz")


def parse_dates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add timestamps read from ISO and German dates with optional time; NULL for anything else.

    ``columns`` maps the new column to its text column.  Fractions are accepted after a time only.
    """
    low, high = (F.lit(day).cast("timestamp_ntz") for day in (_EARLIEST, _LATEST))
    return df.withColumns({new: _stamp(F.col(text)) for new, text in columns.items()}) \
        .withColumns({new: F.when(F.col(new).between(low, high), F.col(new)) for new in columns})


def month_index(c: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return F.year(c) * 12 + F.month(c) - 1


def month_label(index: Column) -> Column:
    """``yyyy-MM`` of a month index."""
    year = F.floor(index / 12).cast("int")
    return F.format_string("%04d-%02d", year, (index - year * 12 + 1).cast("int"))


def whole_days(earlier: Column, later: Column) -> Column:
    """Completed days between two timestamps (not calendar days)."""
    return F.extract(F.lit("DAY"), later - earlier)
