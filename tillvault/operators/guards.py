"""Refusal of rows that would break a table's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyViolation(ValueError):
    """A staging table has null or repeated keys."""


def bad_keys(df: DataFrame, keys: Sequence[str] = ("hash",)) -> DataFrame:
    """Keys that are null or occur more than once, with their number of rows.

    Counting combines on the map side, so one much repeated key is no hot spot.
    """
    is_null = F.lit(False)
    for key in keys:
        is_null = is_null | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("zeilen")).filter((F.col("zeilen") > 1) | is_null)


def check_keys(df: DataFrame, keys: Sequence[str] = ("hash",), what: str = "stage") -> DataFrame:
    """Runs the check now; raises with some of the offending keys, else gives ``df`` back."""
    bad = bad_keys(df, keys)
    found = bad.limit(20).collect()
    if found:
        shown = "; ".join(", ".join(f"{k}={row[k]}" for k in keys) + f" x{row['zeilen']}" for row in found)
        raise KeyViolation(f"{what}: {bad.count()} null or repeated keys: {shown}")
    return df


def check_present(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    """Raises if one of the columns is null somewhere, else gives ``df`` back."""
    missing = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    if any(missing):
        shown = ", ".join(f"{c}: {missing[c]} rows" for c in columns if missing[c])
        raise KeyViolation(f"{what}: missing values in {shown}")
    return df


def split_by_key(df: DataFrame, keys: Sequence[str] = ("hash",)) -> tuple[DataFrame, DataFrame]:
    """(rows with a good key, quarantined rows)."""
    bad = bad_keys(df, keys).select(*(F.col(k).alias(f"_bad_{k}") for k in keys))
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_bad_{key}"))
    return df.join(bad, match, "left_anti"), df.join(bad, match, "left_semi")
