"""Readings of the loaded tables: current and as-of states, and lookups of positions.

Extensions: the data model is made for these, no ready-made query exists for them.
No join here is given a broadcast hint: which side is small depends on the data,
and adaptive execution decides by measured sizes and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillvault.functions.lookups import FOLLOWS
from tillvault.operators.vault import BY_HASH
from tillvault.schemas import Pair

SPREAD = 64  # parts of a day's receipts

def current(hub: DataFrame, sat: DataFrame, pair: Pair, by: Sequence[str] = BY_HASH) -> DataFrame:
    """Every key with its open version; hub and satellite are joined ``by`` columns both have (see ``vault``)."""
    versions = sat.filter("gueltig").select(*by, "gueltig_adtm", *pair.attributes)
    joined = hub.select(*dict.fromkeys(("hash", *by)), *pair.keys).join(versions, list(by))
    return joined.select("hash", *pair.keys, "gueltig_adtm", *pair.attributes)


def valid_on(day: Column) -> Column:
    """Half-open: a version ends on the day its successor begins."""
    return (F.col("gueltig_adtm") <= day) & (day < F.col("gueltig_edtm"))


def as_of(hub: DataFrame, sat: DataFrame, pair: Pair, day: date) -> DataFrame:
    """Every key with the version valid on ``day``."""
    versions = sat.filter(valid_on(F.lit(day))).select("hash", "gueltig_adtm", "gueltig_edtm", *pair.attributes)
    return hub.select("hash", *pair.keys).join(versions, "hash")


def history(hub: DataFrame, sat: DataFrame, pair: Pair) -> DataFrame:
    """Every key with all its versions."""
    versions = sat.select("hash", "gueltig_adtm", "gueltig_edtm", "gueltig", *pair.attributes)
    return hub.select("hash", *pair.keys).join(versions, "hash").drop("hash")


def sold_as(positions: DataFrame, receipts: DataFrame, articles: DataFrame, attributes: list[str]) -> DataFrame:
    """Positions with the article version valid on the day of sale.

    ``articles`` is ``history`` of the articles. Positions of unknown articles, or
    older than the first version, keep nulls. A version counts until it ends or another
    begins, also where their spans overlap (``close_scope="all_versions"`` leaves such).

    The days on which an article was sold are merged with its versions, along time,
    and each day takes the last version before it. So what meets in one task for an
    article are its days and versions, not its lines. The lines are joined to these
    days by article, day and one of ``SPREAD`` parts of the receipts, so a best seller
    is split whether it sold for years or on a single day; an article sold in one
    receipt a day still has one row there. Receipts are joined by their numbers.
    Lines that follow another have no article: with a null for it they match nothing
    and are dealt out by day and part.
    """
    bon = ["kasse_nr", "bon_nr"]
    key = ["_art", "bon_datum", "_teil"]
    day = receipts.select(*bon, "bon_datum", F.pmod(F.xxhash64(*bon), F.lit(SPREAD)).alias("_teil"))
    sold = positions.select("hash", *bon, "art_nr", "menge", "preis_gesamt").join(day, bon).drop(*bon)
    sold = sold.withColumn("_art", F.when(F.col("art_nr") != FOLLOWS, F.col("art_nr")))

    values = [F.col(a).alias(f"art_{a}") for a in attributes]
    versions = articles.filter("gueltig_adtm < gueltig_edtm").select(
        F.col("art_nr").alias("_art"),
        F.col("gueltig_adtm").alias("bon_datum"),
        F.struct(F.col("gueltig_edtm").alias("bis"), *values).alias("_version"),
    )
    merged = sold.filter("_art IS NOT NULL").select(*key).distinct().unionByName(versions, allowMissingColumns=True)
    # A version counts from the day it begins: rows without a part come first.
    along = Window.partitionBy("_art").orderBy("bon_datum", F.col("_teil").asc_nulls_first(), "_version.bis")
    so_far = F.last("_version", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("_gilt", so_far).filter(F.col("_teil").isNotNull() & (F.col("bon_datum") < F.col("_gilt.bis")))
    found = found.select(*key, *(F.col(f"_gilt.art_{a}") for a in attributes))
    rows = ["hash", "art_nr", "menge", "preis_gesamt", "bon_datum"]
    return sold.join(found, key, "left").select(*rows, *(f"art_{a}" for a in attributes))


def main_ean(positions: DataFrame, mean: DataFrame) -> DataFrame:
    """Positions with additional barcodes replaced by the main one (``mean``: current view)."""
    main = mean.select(F.col("ean_m").alias("_ean_m"), F.col("ean_h").alias("_ean_h"))
    joined = positions.join(main, F.col("art_nr") == F.col("_ean_m"), "left")
    return joined.withColumn("art_nr", F.coalesce("_ean_h", "art_nr")).drop("_ean_m", "_ean_h")


def voids(receipts: DataFrame) -> DataFrame:
    """Voided receipts with the receipt that voids them (same till, ``storno_ref`` = its number).

    Voids that name no receipt are in ``voids_without_receipt``.
    """
    voiding = receipts.filter(F.col("storno_ref").isNotNull()).select(
        "kasse_nr",
        F.col("storno_ref").try_cast("bigint").alias("bon_nr"),
        F.col("hash").alias("hash_storno"),
        F.col("bon_nr").alias("bon_nr_storno"),
        F.col("bon_summe").alias("summe_storno"),
    )
    voided = receipts.select("kasse_nr", "bon_nr", "hash", "bon_summe")
    return voiding.join(voided, ["kasse_nr", "bon_nr"])


def voids_without_receipt(receipts: DataFrame) -> DataFrame:
    """Receipts whose ``storno_ref`` is no number (``grund``: 'nummer') or the number of no receipt of the till ('bon')."""
    voiding = receipts.filter(F.col("storno_ref").isNotNull()).select(
        "kasse_nr",
        F.col("storno_ref").try_cast("bigint").alias("bon_nr"),
        "storno_ref",
        F.col("hash").alias("hash_storno"),
        F.col("bon_nr").alias("bon_nr_storno"),
    )
    known = receipts.select("kasse_nr", "bon_nr")
    grund = F.when(F.col("bon_nr").isNull(), "nummer").otherwise("bon")
    return voiding.join(known, ["kasse_nr", "bon_nr"], "left_anti").withColumn("grund", grund).drop("bon_nr")
