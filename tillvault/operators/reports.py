"""Shop reports over receipts, positions and the current master data.

Extensions: the original program names these reports but computes none; the
definitions are ours. All aggregate with map-side combine on sums and counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillvault.functions.calendar import month_text
from tillvault.functions.lookups import PRESS_GROUPS

WEEKDAYS = ("mo", "di", "mi", "do", "fr", "sa", "so")


def order_aid(
    positions: DataFrame, receipts: DataFrame, groups: Sequence[str] | DataFrame, until: date, weeks: int = 4
) -> DataFrame:
    """Mean quantity per article and weekday over the last ``weeks`` weeks before ``until``.

    ``groups`` are product groups, or rows that have them in ``wgr``. A day without
    sales counts as zero. Receipts and groups are filtered before the join.
    """
    since = until - timedelta(weeks=weeks)
    day = receipts.filter((F.col("bon_datum") >= F.lit(since)) & (F.col("bon_datum") < F.lit(until))).select(
        "kasse_nr", "bon_nr", (F.weekday("bon_datum") + 1).alias("wtag")
    )
    sold = positions.select("kasse_nr", "bon_nr", "wgr", "art_nr", "menge")
    if isinstance(groups, DataFrame):
        sold = sold.join(groups.select("wgr").distinct(), "wgr", "left_semi")
    else:
        sold = sold.filter(F.col("wgr").isin(*groups))
    per_day = {
        name: F.coalesce(F.sum(F.when(F.col("wtag") == i, F.col("menge"))), F.lit(0)) / weeks
        for i, name in enumerate(WEEKDAYS, start=1)
    }
    return (
        sold.join(day, ["kasse_nr", "bon_nr"])
        .groupBy("art_nr")
        .agg(*(c.cast("decimal(18,3)").alias(name) for name, c in per_day.items()))
    )


def order_aid_open(
    positions: DataFrame,
    receipts: DataFrame,
    calendar: DataFrame,
    groups: Sequence[str] | DataFrame,
    until: date,
    weeks: int = 4,
) -> DataFrame:
    """As ``order_aid``, but the mean over the days of the period on which the shop was open.

    ``calendar`` (``datum``, ``wtag``) has a row for each such day: a day without sales
    of an article counts as zero, a closed day not at all. Weekdays without an open day
    are null.
    """
    since = until - timedelta(weeks=weeks)

    def inside(day: str) -> Column:
        return (F.col(day) >= F.lit(since)) & (F.col(day) < F.lit(until))

    open_days = calendar.filter(inside("datum")).groupBy("wtag").agg(F.count_distinct("datum").alias("tage"))
    day = receipts.filter(inside("bon_datum")).select("kasse_nr", "bon_nr", (F.weekday("bon_datum") + 1).alias("wtag"))
    sold = positions.select("kasse_nr", "bon_nr", "wgr", "art_nr", "menge")
    if isinstance(groups, DataFrame):
        sold = sold.join(groups.select("wgr").distinct(), "wgr", "left_semi")
    else:
        sold = sold.filter(F.col("wgr").isin(*groups))
    # Summed per article, then one row an article and open weekday: seven at most.
    sums = {f"_{i}": F.sum(F.when(F.col("wtag") == i, F.col("menge"))) for i in range(1, 8)}
    per_article = sold.join(day, ["kasse_nr", "bon_nr"]).groupBy("art_nr").agg(*(c.alias(n) for n, c in sums.items()))
    rows = per_article.select("art_nr", F.posexplode(F.array(*sums)).alias("_vor", "menge")).withColumn("wtag", F.col("_vor") + 1)
    means = rows.join(F.broadcast(open_days), "wtag", "left").withColumn("_mittel", F.coalesce("menge", F.lit(0)) / F.col("tage"))
    return means.groupBy("art_nr").agg(
        *(F.max(F.when(F.col("wtag") == i, F.col("_mittel"))).cast("decimal(18,3)").alias(name) for i, name in enumerate(WEEKDAYS, 1))
    )


def inventory_articles(articles: DataFrame, groups: DataFrame, deposits: DataFrame) -> DataFrame:
    """Current articles with group name, VAT rate and deposit; without press groups.

    Arguments are current views. Articles of unknown groups stay in the list.
    """
    listed = articles.filter(~F.coalesce(F.col("wgr").isin(*PRESS_GROUPS.values()), F.lit(False))).select(
        "art_nr", "art_bez", "mengeneinheit", "vk_brutto", "wgr"
    )
    return (
        listed.join(groups.select("wgr", "wgr_bez", "mwst_satz"), "wgr", "left")
        .join(deposits.select("art_nr", "pfand_brutto"), "art_nr", "left")
        .select("art_nr", "art_bez", "mengeneinheit", "vk_brutto", "wgr", "wgr_bez", "mwst_satz", "pfand_brutto")
    )


def inventory_supplier_articles(supplier_articles: DataFrame, suppliers: DataFrame, articles: DataFrame) -> DataFrame:
    """Current supplier articles with supplier and article name; arguments are current views."""
    return (
        supplier_articles.select("ean", "lief_nr", "lief_art_nr", "ek_netto")
        .join(suppliers.select("lief_nr", "lief_name"), "lief_nr", "left")
        .join(articles.select(F.col("art_nr").alias("ean"), "art_bez", "vk_brutto"), "ean", "left")
        .select("ean", "lief_nr", "lief_name", "lief_art_nr", "ek_netto", "art_bez", "vk_brutto")
    )


def transaction_mix(journal: DataFrame) -> DataFrame:
    """Receipts, positions and amount by receipt type, position type and month.

    Lines are first summed per receipt, so that counting receipts needs no
    count-distinct over all lines of a type.
    """
    per_receipt = journal.groupBy(
        "kasse_nr", "bon_nr", "bon_typ", "pos_typ", month_text(F.col("bon_abschluss")).alias("monat")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("preis_gesamt").alias("summe"))
    return per_receipt.groupBy("bon_typ", "pos_typ", "monat").agg(
        F.count(F.lit(1)).alias("bons"),
        F.sum("n").alias("positionen"),
        F.sum("summe").cast("decimal(18,2)").alias("summe"),
    )


def visits_by_hour(receipts: DataFrame) -> DataFrame:
    """Receipts per weekday and hour. The receipts table has one row per receipt."""
    return receipts.groupBy(
        (F.weekday("bon_datum") + 1).alias("wtag"), F.hour(F.col("bon_abschluss")).alias("stunde")
    ).agg(F.count(F.lit(1)).alias("besuche"), F.sum("bon_summe").cast("decimal(18,2)").alias("summe"))


def visits_by_customer(receipts: DataFrame) -> DataFrame:
    """Receipts per customer and month; customer 0 is everyone without a card."""
    return receipts.groupBy("kdnr", month_text(F.col("bon_datum")).alias("monat")).agg(
        F.count(F.lit(1)).alias("besuche"), F.sum("bon_summe").cast("decimal(18,2)").alias("summe")
    )


def month_totals(receipts: DataFrame, positions: DataFrame) -> DataFrame:
    """Receipts, positions, quantity and amount per month.

    Positions are summed per receipt before the join, so the join is one to one
    and a long receipt is no hot key.
    """
    per_receipt = positions.groupBy("kasse_nr", "bon_nr").agg(
        F.count(F.lit(1)).alias("n"), F.sum("menge").alias("menge"), F.sum("preis_gesamt").alias("umsatz")
    )
    days = receipts.select("kasse_nr", "bon_nr", month_text(F.col("bon_datum")).alias("monat"))
    return (
        days.join(per_receipt, ["kasse_nr", "bon_nr"])
        .groupBy("monat")
        .agg(
            F.count(F.lit(1)).alias("bons"),
            F.sum("n").alias("positionen"),
            F.sum("menge").cast("decimal(18,3)").alias("menge"),
            F.sum("umsatz").cast("decimal(18,2)").alias("umsatz"),
        )
    )
