"""Insert-if-absent: the incremental load of every insert-only table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK_BITS = 26


def absent(
    new: DataFrame, existing: DataFrame, key: str | Sequence[str] = "hash", null_keys: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` (only the key columns are read).

    The key may be the hash or the columns it is made of. At scale take the
    columns: as small sorted numbers they compress to a fraction of the hashes, and
    rows that lie by one of them need not move. In ``null_keys`` a null equals a null,
    as it does in a hash; in the other columns it equals nothing.
    """
    names = [key] if isinstance(key, str) else list(key)
    if not null_keys:
        return new.join(existing.select(*names), names, "left_anti")
    match = F.lit(True)
    for name in names:
        mine, theirs = F.col(f"n.{name}"), F.col(f"e.{name}")
        match = match & (mine.eqNullSafe(theirs) if name in null_keys else mine == theirs)
    return new.alias("n").join(existing.select(*names).alias("e"), match, "left_anti")


def marks(keys: DataFrame, on: Sequence[str], bits: int = MARK_BITS) -> DataFrame:
    """(bucket, marks): a membership filter of the key values, at most 2^bits bits whatever their number."""
    slots = keys.select(_slot(on, bits).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_marks")
    )


def _slot(on: Sequence[str], bits: int) -> Column:
    # Positions count from 1.
    return F.xxhash64(*on).bitwiseAND(F.lit((1 << bits) - 1)) + 1


def likely(existing: DataFrame, keys: DataFrame, on: Sequence[str], bits: int = MARK_BITS) -> DataFrame:
    """The part of ``existing`` that may have a key of ``keys``: all that have one, and a few others.

    The filter is a table of at most 2^bits / 2^15 rows of 4 KB, so its broadcast is
    bounded. It runs where ``existing`` is read, before anything is shuffled. Full of
    marks, it lets more rows through; what an exact join then finds is the same.
    """
    slot = _slot(on, bits)
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_marks", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = existing.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(marks(keys, on, bits)), "_bucket")
    return found.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*existing.columns)


def insert_absent(
    new: DataFrame, existing: DataFrame, key: str | Sequence[str] = "hash", null_keys: Sequence[str] = ()
) -> DataFrame:
    """``existing`` plus the rows of ``new`` it does not have yet (see ``absent``)."""
    return existing.unionByName(absent(new, existing, key, null_keys))


def first_of_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key.

    Meant for keys that repeat once per delivered file, as when one batch holds
    files that would otherwise be loaded one after the other.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_platz", place).filter(F.col("_platz") == 1).drop("_platz")


def within(existing: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """The part of ``existing`` inside the range that ``column`` has in ``new``.

    An exact restriction for keys that contain the column: rows outside cannot
    match. The two bounds are literals, so Parquet skips whole row groups by
    their statistics. Reads one column of ``new`` now.
    """
    low, high = new.agg(F.min(column), F.max(column)).first()
    if low is None:
        return existing.filter(F.lit(False))
    return existing.filter(F.col(column).between(low, high))
