"""As-of lookups against brute force, and how their work is dealt out."""

import random
from datetime import date, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from tillvault.operators import views

START, END = date(2023, 1, 1), date(9999, 12, 31)


def history_of(rnd, articles):
    """(article, from, until, price): versions that follow each other, some with a gap after them."""
    rows = []
    for art in articles:
        begins = sorted(rnd.sample(range(0, 60), rnd.randint(1, 5)))
        for k, begin in enumerate(begins):
            end = START + timedelta(begins[k + 1]) if k + 1 < len(begins) else rnd.choice([END, START + timedelta(begin + 3)])
            rows.append((art, START + timedelta(begin), end, f"{art}-{k}"))
    return rows


def tables(spark, sales, versions):
    """sales: (receipt, article, day)"""
    positions = spark.createDataFrame(
        [(f"h{i}", 1, bon, art, i, i) for i, (bon, art, _) in enumerate(sales)],
        "hash string, kasse_nr int, bon_nr long, art_nr string, menge int, preis_gesamt int",
    )
    receipts = spark.createDataFrame(
        sorted({(1, bon, day) for bon, _, day in sales}), "kasse_nr int, bon_nr long, bon_datum date"
    )
    articles = spark.createDataFrame(versions, "art_nr string, gueltig_adtm date, gueltig_edtm date, preis string")
    return positions, receipts, articles


@pytest.mark.parametrize("seed", [1, 2])
def test_sold_as(spark, seed):
    rnd = random.Random(seed)
    versions = history_of(rnd, ["a", "b", "c"])
    days = {bon: START + timedelta(rnd.randint(-2, 70)) for bon in range(120)}
    sales = [(bon, rnd.choice(["a", "a", "b", "c", "unknown", "-", None]), days[bon]) for bon in rnd.choices(range(120), k=500)]
    got = views.sold_as(*tables(spark, sales, versions), ["preis"])
    assert got.columns == ["hash", "art_nr", "menge", "preis_gesamt", "bon_datum", "art_preis"]
    expected = set()
    for i, (_, art, day) in enumerate(sales):
        valid = [p for a, begin, end, p in versions if a == art and begin <= day < end]
        assert len(valid) <= 1
        expected.add((f"h{i}", art, i, i, day, valid[0] if valid else None))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(sales) and set(rows) == expected


def test_a_version_counts_until_another_begins(spark):
    versions = [("a", START, END, "old"), ("a", START + timedelta(5), END, "new"), ("a", START + timedelta(5), START + timedelta(5), "void")]
    sales = [(1, "a", START + timedelta(4)), (2, "a", START + timedelta(5))]
    got = views.sold_as(*tables(spark, sales, versions), ["preis"]).orderBy("hash")
    assert [r.art_preis for r in got.collect()] == ["old", "new"]


@pytest.mark.parametrize("n_days", [1, 365])
def test_best_seller_is_split(spark, n_days):
    """One article with a third of all lines, over a year or on one day: no task has twice the median."""
    lines = spark.range(60_000).select(
        F.md5(F.col("id").cast("string")).alias("hash"),
        F.lit(1).alias("kasse_nr"),
        F.floor(F.col("id") / 3).cast("long").alias("bon_nr"),
        F.when(F.col("id") % 3 == 0, "best").otherwise(F.concat(F.lit("a"), F.col("id") % 997)).alias("art_nr"),
        F.lit(1).alias("menge"),
        F.lit(1).alias("preis_gesamt"),
    )
    receipts = spark.range(20_000).selectExpr(
        "1 AS kasse_nr", "id AS bon_nr", f"date_add(DATE'2023-01-01', cast(id % {n_days} AS int)) AS bon_datum"
    )
    versions = spark.createDataFrame([("best", START, END, "x")], "art_nr string, gueltig_adtm date, gueltig_edtm date, preis string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sold = views.sold_as(lines, receipts, versions, ["preis"])
        tasks = [r["count"] for r in sold.groupBy(F.spark_partition_id()).count().collect() if r["count"]]
        assert sold.filter("art_preis = 'x'").count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tasks) > 1 and sum(tasks) == 60_000 and max(tasks) <= 2 * median(tasks)
