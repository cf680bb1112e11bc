"""Parts of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(day: Column) -> dict[str, Column]:
    """Calendar year, month, day, ISO weekday (Monday = 1) and ISO week."""
    return {
        "jahr": F.year(day),
        "monat": F.month(day),
        "tag": F.dayofmonth(day),
        "wtag": F.weekday(day) + 1,
        "kw": F.weekofyear(day),
    }


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
