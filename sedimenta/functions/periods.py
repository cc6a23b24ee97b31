"""Period lengths and money strings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.dates import day

#: Inclusive day ranges of period kinds, and their names in labels.
CALIBERS = [("Q", 77, 106), ("H", 168, 197), ("N9M", 259, 289), ("FY", 351, 380)]
NAMES = {"H": "half year", "N9M": "nine months", "FY": "full year"}


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def text_days(start: Column, end: Column) -> Column:
    """Inclusive days between text dates; null where one is no date."""
    return inclusive_days(day(start), day(end))


def caliber(days: Column) -> Column:
    """The kind of a period by its days: X for other lengths, null for none."""
    out = F.when(days.isNull() | (days <= 0), F.lit(None).cast("string"))
    for name, low, high in CALIBERS:
        out = out.when(days.between(low, high), name)
    return out.otherwise("X")


def period_label(kind: Column, start: Column, end: Column, days: Column) -> Column:
    """What a reader sees: 2024 Q3, full year (2024-09), the end of a point in time, or the days and the start."""
    month = F.substring(end, 6, 2).cast("int")
    names = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    quarter = F.concat(F.substring(end, 1, 4), F.lit(" Q"), F.floor((month - 1) / 3 + 1).cast("string"))
    long = F.concat(names[kind], F.lit(" ("), F.substring(end, 1, 7), F.lit(")"))
    other = F.concat(F.coalesce(days, F.lit(0)).cast("string"), F.lit(" days ("), F.coalesce(start, F.lit("nil")), F.lit(")"))
    return F.when((kind == "I") | ~F.coalesce(end.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), end).when(kind == "Q", quarter).when(kind.isin(*NAMES), long).otherwise(other)


def range_label(kind: Column, start: Column, end: Column) -> Column:
    return F.when(F.coalesce(kind == "I", F.lit(False)) | start.isNull(), end).otherwise(F.concat(start, F.lit(" ~ "), end))


def millions(v: Column) -> Column:
    """A decimal in millions, half up to one place, without a final .0; small negatives keep their sign."""
    x = F.format_number(F.round(F.abs(v) / F.lit(1_000_000).cast("decimal(10,0)"), 1), 1)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.regexp_replace(x, r"\.0$", ""))


def whole_money(v: Column) -> Column:
    """A decimal to whole units with digits in groups."""
    return F.concat(F.when(v < 0, "-").otherwise(""), F.format_number(F.bround(F.abs(v), 0), 0))


def _four_places(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in parts:
        text = v.map(lambda x: None if x is None or pd.isna(x) else f"{x:.4f}").astype("object")
        yield text.str.replace(r"(\.\d\d\d?[1-9]|\.\d\d)0*$", r"\1", regex=True)


def per_share(v: Column) -> Column:
    """Four places, rounded as the binary value is, without final zeros beyond two places.

    A pandas function: Spark's own formatting rounds the decimal text half up (0.125 to 0.13).
    """
    return F.pandas_udf(_four_places, "string")(v)


def scale(most: Column) -> Column:
    """1,000,000 where the largest value of a table reaches a million, else 1."""
    return F.when(most >= 1_000_000, 1_000_000).otherwise(1)


def money(v: Column, unit: Column) -> Column:
    """A value in the scale of its table; null is empty."""
    return F.when(v.isNull(), "").when(unit == 1_000_000, millions(v)).otherwise(whole_money(v))
