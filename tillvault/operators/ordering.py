"""Numbering and carry-forward along an order, without a task per group or file.

Both work block by block. A block is a run of neighbouring rows of one group
(here: of one receipt number) whose size is bounded, so a receipt number that
holds a third of all rows is spread over many tasks. What has to cross a block
border is one small row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

BLOCK = "_block"
HOT_ROWS = 1 << 20
BUCKET_BITS = 20
FAN = 22  # bits by which buckets are taken together
PLACE_BITS = 31  # of a place in its receipt


def block_hot_groups(
    df: DataFrame, group: Sequence[str], parts: dict[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Adds ``_block``: null parts for ordinary groups, ``parts`` for hot ones.

    ``parts`` must not decrease along the order. For data whose place in a file
    is unknown; rows read in file order have their block already.
    """
    # At most one row per ``hot_rows`` rows of the table passes the filter; how it is
    # joined is left to its measured size.
    hot = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = hot.select(*group, F.lit(True).alias("_heiss"))
    block = F.struct(*(F.when(F.col("_heiss"), c).alias(n) for n, c in parts.items()))
    return df.join(hot, list(group), "left").withColumn(BLOCK, block)


def number_in_order(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    crossing: Column | None = None,
) -> DataFrame:
    """Adds ``name``: the place of the row in its group, from 0, along ``order``.

    ``_block`` must not decrease along ``order`` within a group. ``crossing``
    may restrict the rows whose groups can have several blocks.
    """
    in_block = Window.partitionBy(*group, BLOCK).orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    sizes = df if crossing is None else df.filter(crossing)
    sizes = sizes.groupBy(*group, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    # Only blocks that have a predecessor in their group are needed.
    before = sizes.withColumn("_davor", F.sum("_n").over(earlier)).filter(F.col("_davor").isNotNull())

    # Window and join share their keys, so the rows are shuffled once.
    rows = df.withColumn("_in_block", F.row_number().over(in_block))
    rows = rows.join(before.drop("_n"), [*group, BLOCK], "left")
    place = (F.col("_in_block") - 1 + F.coalesce("_davor", F.lit(0))).cast("int")
    return rows.withColumn(name, place).drop("_in_block", "_davor")


def _in_bucket(receipt: str, place: Column) -> Column:
    """(receipt, place) inside its bucket of receipts as one long, ordered like them: it is summed by hash."""
    low = F.col(receipt).cast("long").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    return F.shiftleft(low, PLACE_BITS) + place


def _in_till(inside: Column) -> Column:
    """``_in_bucket`` and the bucket it is in, ordered over a whole till: at most 96 bits, as a decimal."""
    bucket = F.col("_eimer").cast("decimal(20,0)") + Decimal(1 << (63 - BUCKET_BITS))
    return bucket * Decimal(1 << (BUCKET_BITS + PLACE_BITS)) + inside


def _bucket_and_inside(packed: Column) -> tuple[Column, Column]:
    """The two parts of ``_in_till``."""
    size = F.lit(Decimal(1 << (BUCKET_BITS + PLACE_BITS)))
    bucket = F.call_function("div", packed, size) - F.lit(1 << (63 - BUCKET_BITS))
    return bucket, (packed % size).cast("long")


def _leader(till: Column, bucket: Column, inside: Column, names: Sequence[str], receipt_type: DataType) -> Column:
    receipt = F.shiftleft(bucket, BUCKET_BITS) + F.shiftright(inside, PLACE_BITS)
    place = inside.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return F.struct(*(c.alias(n) for c, n in zip((till, receipt.cast(receipt_type), place), names)))


def _before_each(buckets: DataFrame, scope: Sequence[str], till: str, bits: int) -> DataFrame:
    """The last ``_ende`` before each bucket of its scope, and the scope's first ``_anfang``, each with its till.

    Buckets are taken together by their upper bits, again and again, until a till is
    one row. So a task sees at most 2^FAN buckets of one till, however far receipt
    numbers lie apart, and in the end one row per till of a file.
    """
    earlier = (Window.unboundedPreceding, -1)
    last = F.when(F.col("_ende").isNotNull(), F.struct(F.col(till).alias("kasse"), F.col("_ende").alias("wert")))
    if bits <= 0:
        order = Window.partitionBy(*scope).orderBy(till)
        first = F.struct(F.col(till).alias("kasse"), F.col("_anfang").alias("wert"))
        return buckets.select(
            *scope,
            till,
            F.last(last, ignorenulls=True).over(order.rowsBetween(*earlier)).alias("_eimer_ende"),
            F.first(first).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_anfang"),
        )
    top = bits <= FAN
    group = [*scope, till] if top else [*scope, till, "_gruppe"]
    rows = buckets if top else buckets.withColumn("_gruppe", F.shiftright("_eimer", FAN))
    sums = rows.groupBy(*group).agg(F.max("_ende").alias("_ende"), F.min("_anfang").alias("_anfang"))
    if top:
        above = _before_each(sums, scope, till, 0)
    else:
        above = _before_each(sums.withColumnRenamed("_gruppe", "_eimer"), scope, till, bits - FAN)
        above = above.withColumnRenamed("_eimer", "_gruppe")
    inside = Window.partitionBy(*group).orderBy("_eimer").rowsBetween(*earlier)
    own = rows.select(*group, "_eimer", F.last(last, ignorenulls=True).over(inside).alias("_innen"))
    return own.join(above, group, "left").select(
        *scope, till, "_eimer", F.coalesce("_innen", "_eimer_ende").alias("_eimer_ende"), "_anfang"
    )


def number_and_carry(
    df: DataFrame,
    scope: Sequence[str],
    till: str,
    receipt: str,
    order: Sequence[str],
    leads: Column,
    place: str,
    leader: str,
) -> DataFrame:
    """``number_in_order`` over (scope, receipt), plus ``leader``: struct(till, receipt,
    place) of the last leading row so far.

    The order of the carry is (till, receipt, place) within ``scope``; a row before
    any leading one gets the first row of its scope. Each step is over far fewer
    rows: inside the block, over blocks inside a bucket of receipts, over buckets in
    a tree. The rows themselves are shuffled once, on (scope, receipt, block).
    """
    part = [*scope, receipt, BLOCK]

    # Inside the block.
    numbered = df.withColumn("_nr", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    lead_nr = F.when(leads, F.col("_nr"))
    so_far = Window.partitionBy(*part, till).orderBy("_nr").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered.withColumn("_lead_nr", F.last(lead_nr, ignorenulls=True).over(so_far))

    # One row per block and till: numbers only, so this aggregates by hash.
    blocks = numbered.groupBy(*part, till).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_nr").alias("_von"),
        F.min(lead_nr).alias("_erste"),
        F.max(lead_nr).alias("_letzte"),
    )
    # Rows of the receipt in earlier blocks (the tills of one block share its start).
    earlier = Window.partitionBy(*scope, receipt).orderBy(BLOCK).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = Window.partitionBy(*scope, receipt, BLOCK)
    blocks = blocks.withColumn("_davor", F.sum("_n").over(earlier) - F.sum("_n").over(here))
    # The next two steps both start from this shuffle and read all its columns.
    blocks = blocks.withColumn("_eimer", F.shiftright(receipt, BUCKET_BITS)).repartition(*scope, till, "_eimer")
    end = _in_bucket(receipt, F.col("_letzte") + F.col("_davor"))
    start = _in_bucket(receipt, F.col("_von") + F.col("_davor"))

    # Over the blocks of a bucket: a bucket spans 2^20 receipt numbers.
    in_bucket = Window.partitionBy(*scope, till, "_eimer").orderBy(receipt, BLOCK)
    last_end = F.last(end, ignorenulls=True).over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))

    # Over the buckets of a file: one row per till and 2^20 receipt numbers.
    buckets = blocks.groupBy(*scope, till, "_eimer").agg(
        F.max(end).alias("_ende"), F.min(start).alias("_anfang")
    )
    buckets = buckets.withColumns({"_ende": _in_till(F.col("_ende")), "_anfang": _in_till(F.col("_anfang"))})
    buckets = _before_each(buckets, scope, till, 64 - BUCKET_BITS)

    # Rows need a look at their block only if it has a predecessor in its receipt,
    # or begins with a row that follows a leading one further back.
    opened = F.col("_erste").isNull() | (F.col("_von") < F.col("_erste"))
    names, kind = (till, receipt, place), df.schema[receipt].dataType

    def far(of: str) -> Column:
        return _leader(F.col(f"{of}.kasse"), *_bucket_and_inside(F.col(f"{of}.wert")), names, kind)

    needed = (
        blocks.withColumn("_ende", last_end)
        .filter(opened | (F.col("_davor") > 0))
        .join(buckets, [*scope, till, "_eimer"], "left")
        .select(
            *part,
            F.col(till).alias("_till"),
            "_davor",
            F.when(F.col("_ende").isNotNull(), _leader(F.col(till), F.col("_eimer"), F.col("_ende"), names, kind))
            .when(F.col("_eimer_ende").isNotNull(), far("_eimer_ende"))
            .otherwise(far("_anfang"))
            .alias("_geerbt"),
        )
    )

    # The till is compared as a range, not as a key, so that the join keys are
    # those the rows are partitioned by already and the rows stay where they are.
    match = F.col(f"r.{till}").between(F.col("b._till"), F.col("b._till"))
    for key in part:
        match = match & (F.col(f"r.{key}") == F.col(f"b.{key}"))
    before = F.coalesce("b._davor", F.lit(0))
    own = F.struct(f"r.{till}", f"r.{receipt}", (F.col("r._lead_nr") + before).alias(place))
    return (
        rows.alias("r")
        .join(needed.alias("b"), match, "left")
        .select(
            "r.*",
            (F.col("r._nr") + before).cast("int").alias(place),
            F.when(F.col("r._lead_nr").isNotNull(), own).otherwise(F.col("b._geerbt")).alias(leader),
        )
        .drop("_nr", "_lead_nr")
    )
