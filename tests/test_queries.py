"""Every catalogue query against its SQL, on the smallest tables; and its history properties."""

import pytest
from compare import differences, engine
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillvault.operators import vault
from tillvault.plans import catalog, frames
from tillvault.plans.oracles import oracles

# The text operators have tests of their own and may be absent.
QUERIES, ORACLES = catalog.catalog(), oracles()


def test_the_contract_has_every_query():
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.fixture(scope="module")
def db():
    return engine(SF_DIR)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["monat", "bons", "positionen", "menge", "umsatz"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert differences(spark, db, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("load", ["articles", "supplier_articles"])
def test_history_properties(spark, load):
    stages, pair = frames.snapshots(spark, SF_DIR, load), frames.pair_of(load)
    hub, sat = vault.replay(stages, pair)
    sat = sat.persist()
    try:
        # one by one equals in bulk
        bulk = vault.bulk_sat(catalog.stacked(stages), pair)
        assert sat.exceptAll(bulk).isEmpty() and bulk.exceptAll(sat).isEmpty()
        # exactly one open version per key of the hub
        versions = sat.groupBy("hash").agg(F.count_if("gueltig").alias("offen"))
        assert versions.filter("offen <> 1").isEmpty()
        assert versions.count() == hub.count()
        # versions of a key do not overlap
        other = sat.select("hash", F.col("gueltig_adtm").alias("a"), F.col("gueltig_edtm").alias("e"))
        overlap = sat.join(other, "hash").filter("a > gueltig_adtm AND a < gueltig_edtm")
        assert overlap.isEmpty()
    finally:
        sat.unpersist()


def test_hot_receipts_give_the_same_positions(spark):
    """With a low limit every receipt is split into blocks; the result stays the same."""
    whole = frames.journal(spark, SF_DIR).select("hash", "pos", "art_nr", "preis_gesamt")
    split = frames.journal(spark, SF_DIR, hot_rows=2).select(whole.columns)
    assert whole.exceptAll(split).isEmpty() and whole.count() == split.count()
    whole = frames.journal_with_leading(spark, SF_DIR).select("hash", "hash_fuehrend", "art_nr", "preis_gesamt")
    split = frames.journal_with_leading(spark, SF_DIR, hot_rows=2).select(whole.columns)
    assert whole.exceptAll(split).isEmpty() and whole.count() == split.count()
