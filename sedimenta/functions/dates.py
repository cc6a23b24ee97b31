"""Text dates: a shape test only, as listings hold dates like 2026-02-31, and day counts that never fail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape of a date.
SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def is_date(x: Column) -> Column:
    """Whether the text has the shape of a date; null has not."""
    return F.coalesce(x.rlike(SHAPE), F.lit(False))


def day(x: Column) -> Column:
    """The date, or null where the text has another shape or names no day of the calendar."""
    # a cast takes half the time of a pattern; unlike that it would skip a final line feed
    return F.when(is_date(x) & (F.length(x) == 10), x.try_cast("date"))


def years_before(today: dt.date, years: int) -> str:
    """The same day some years earlier; 28 February where there is no 29."""
    year = today.year - years
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return f"{year:04d}-{today.month:02d}-{28 if (today.month, today.day) == (2, 29) and not leap else today.day:02d}"
