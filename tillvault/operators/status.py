"""What has been loaded, and when: one-column scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillvault.functions.calendar import month_text


def loaded_months(receipt_rows: DataFrame) -> DataFrame:
    """The months that have receipts, in order."""
    return receipt_rows.select(month_text(F.col("bon_datum")).alias("monat")).distinct().orderBy("monat")


def last_change(receipt_rows: DataFrame) -> DataFrame:
    """Time of the last load that added receipts; null if there are none."""
    return receipt_rows.agg(F.max("eintrag_ts").alias("zeitpunkt"))


def last_file(hub: DataFrame, quelle: str | None = None) -> DataFrame:
    """Date of the newest export; with ``quelle`` among the keys first seen in that source."""
    rows = hub if quelle is None else hub.filter(F.col("quelle") == quelle)
    return rows.agg(F.max("zuletzt_gesehen").alias("zeitpunkt"))
