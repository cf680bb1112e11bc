"""The batch stamp: where a row came from and when."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_time(load_ts: datetime | Column) -> Column:
    """Wall-clock load time. A job parameter, so that a repeated task gives the same rows."""
    if isinstance(load_ts, Column):
        return load_ts
    return F.lit(load_ts.isoformat(sep=" ")).cast("timestamp_ntz")


def batch_stamp(quelle: str, load_ts: datetime | Column, export_date: date | Column) -> dict[str, Column]:
    return {
        "quelle": F.lit(quelle),
        "eintrag_ts": load_time(load_ts),
        "export_datum": F.lit(export_date),
    }


def parse_export_date(text: str) -> date:
    """``dd.mm.yyyy`` -> date."""
    return datetime.strptime(text, "%d.%m.%Y").date()
