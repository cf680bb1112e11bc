"""Typed export rows -> staging rows of one hub/satellite pair.

Every stage is a narrow projection (no shuffle): derive the pair's columns,
hash key and attributes, stamp the batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillvault.functions import keys, lookups
from tillvault.schemas import EXPORTS, PAIRS, Export, stage_columns
from tillvault.sources.stamp import batch_stamp

# Fixed value: the supplier all press articles come from.
PRESS_SUPPLIER = "34"


def group_code(df: DataFrame) -> Column:
    """``wgr:uwgr``; null if either is null."""
    return F.concat(F.col("wgr"), F.lit(":"), F.col("uwgr"))


def _articles(df: DataFrame) -> DataFrame:
    return df.withColumn("wgr", group_code(df))


def _deposits(df: DataFrame) -> DataFrame:
    return df.withColumn("wgr", group_code(df)).filter(F.col("art_nr").isNotNull())


def _groups(df: DataFrame) -> DataFrame:
    missing = F.lit(keys.MISSING)
    return df.withColumns(
        {
            "wgr": F.concat(F.coalesce("wgr", missing), F.lit(":"), F.coalesce("uwgr", missing)),
            "mwst_satz": lookups.vat_rate(F.col("mwst_kz")),
        }
    )


def _press_articles(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "idx": F.lit(0),
            "scs_pool_id": F.col("art_nr").cast("bigint"),
            "mengenfaktor": F.lit(1).cast("decimal(18,3)"),
            "preiseinheit": F.lit(1),
            "preisgebunden_kz": F.lit("J"),
            "rabatt_kz": F.lit("N"),
            "wgr": lookups.press_group(F.col("mwst_kz")),
        }
    )


def _press_supplier_articles(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("art_nr").alias("ean"),
        F.lit(PRESS_SUPPLIER).alias("lief_nr"),
        F.col("art_nr").alias("lief_art_nr"),
        "ek_netto",
    )


# What has to be derived before hashing, per (export, pair).
_BEFORE = {
    ("articles", "artikel"): _articles,
    ("deposits", "pfand"): _deposits,
    ("groups", "warengruppen"): _groups,
    ("press_articles", "artikel"): _press_articles,
    ("press_articles", "scs_liefart"): _press_supplier_articles,
}


def unit_default(unit: Column) -> Column:
    return F.when(unit == 0, F.lit(1)).otherwise(unit)


def stage(
    rows: DataFrame,
    export: str,
    pair: str,
    export_date: date | Column,
    load_ts: datetime | Column,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Staging rows of ``pair`` from typed rows of ``export``.

    Date and time may be columns, of the rows of several exports. ``extra`` columns of
    the rows are kept (see ``vault.bulk_sat``).
    """
    spec: Export = EXPORTS[export]
    target = next(t for t in spec.targets if t.pair == pair)
    shape = PAIRS[pair]
    derive = _BEFORE.get((export, pair))
    df = derive(rows) if derive else rows
    df = df.withColumns(
        {
            "hash": keys.business_key(df, list(shape.keys)),
            "hash_diff": keys.change_hash(df, target.diff),
            **batch_stamp(spec.quelle, load_ts, export_date),
        }
    )
    if export == "articles":
        # After hashing: a unit of 0 that becomes 1 is no change.
        df = df.withColumn("preiseinheit", unit_default(F.col("preiseinheit")))
    present = set(df.columns)
    return df.selectExpr(
        *(
            f"cast({name if name in present else 'NULL'} AS {kind}) AS {name}"
            for name, kind in stage_columns(shape).items()
        ),
        *extra,
    )
