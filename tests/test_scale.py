"""What keeps shuffles and tasks in bounds as the tables grow."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_plans import plan_of

from tillvault.operators import insert, vault
from tillvault.plans import catalog, frames
from tillvault.plans.session import INPUT_OF_PARTITION, tune

QUERIES = catalog.catalog()


def physical(spark, name: str) -> str:
    """The plan over tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["sat_bulk_supplier_articles", "hub_bulk_supplier_articles"])
def test_bulk_forms_shuffle_the_table_once(spark, name):
    plan = physical(spark, name)
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


@pytest.mark.parametrize("name", ["sat_history_supplier_articles", "sat_bulk_supplier_articles", "hub_bulk_supplier_articles"])
def test_hashes_are_not_shuffled(spark, name):
    assert "hashpartitioning(hash" not in physical(spark, name)


def test_current_supplier_articles_are_joined_where_they_lie(spark):
    """Inventory: only hubs and satellites of suppliers and articles are joined by hash."""
    df = catalog._current(spark, SF_DIR, "supplier_articles")
    assert "hashpartitioning(hash" not in plan_of(spark, df)


def test_keys_that_are_missing_are_versions_of_one(spark):
    """A missing number has a hash: it counts as a key, by these columns as by the hash."""
    rows = spark.sql(
        "SELECT * FROM VALUES (NULL, 1L, 30000D, 0L), (NULL, NULL, 30000D, 1L), (2L, NULL, 70000D, 2L), (2L, 1L, 100D, 0L) AS "
        "t (l_partkey, l_suppkey, preis, zurueck)"
    )
    named = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(n) for c, n in (("l_partkey", "_teil"), ("l_suppkey", "_lieferant"))]
    table = rows.select(*named, "preis", "zurueck")
    made = frames.INPUTS["supplier_articles"]
    pair, by = frames.pair_of("supplier_articles"), frames.key_of("supplier_articles")
    held = frames.INPUTS["supplier_articles"]
    frames.INPUTS["supplier_articles"] = frames.Input(lambda *_: table, made.rows, made.missing_1, made.missing_2, made.step_1, made.step_2, by)
    try:
        stages = frames.snapshots(spark, SF_DIR, "supplier_articles")
        stacked = frames.stacked(spark, SF_DIR, "supplier_articles")
    finally:
        frames.INPUTS["supplier_articles"] = held
    plain = catalog.stacked(stages)
    assert sorted(stacked.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)
    sats = [vault.bulk_sat(stacked, pair, by), vault.replay(stages, pair, by=by)[1], vault.bulk_sat(plain, pair), vault.replay(stages, pair)[1]]
    wanted, *others = ([str(r) for r in sorted(s.drop(*by).collect(), key=str)] for s in sats)
    assert wanted and all(rows == wanted for rows in others)
    hubs = [sorted(map(str, h.drop(*by).collect())) for h in (vault.bulk_hub(stacked, pair, by), vault.bulk_hub(plain, pair))]
    assert hubs[0] == hubs[1] and len(hubs[0]) == 4


@pytest.mark.parametrize("name", ["journal_anti_load", "journal_filtered_load", "positions_load", "receipts_load", "last_change"])
def test_loads_leave_numbered_lines_where_they_lie(spark, name):
    """Lines lie by receipt number: neither the numbering nor the join with loaded keys moves them again."""
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", physical(spark, name))
    assert keys and not any("hash#" in k or "pos#" in k for k in keys)


def test_sold_lines_are_numbered_where_they_lie(spark):
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", physical(spark, "asof_sale"))
    assert keys and not any("_block#" in k for k in keys)


def test_a_till_that_is_missing_is_a_till(spark):
    """As in the hash of a position, a null till equals a null till; nulls elsewhere equal nothing."""
    kind = "kasse_nr int, bon_nr long, pos int"
    old = spark.createDataFrame([(None, 1, 0), (2, 1, 0), (2, None, 0)], kind)
    new = spark.createDataFrame([(None, 1, 0), (None, 1, 1), (1, 1, 0), (2, 1, 0), (2, None, 0)], kind)
    added = insert.absent(new, old, catalog.POSITION_KEY, catalog.TILL)
    assert sorted(map(str, map(tuple, added.collect()))) == ["(1, 1, 0)", "(2, None, 0)", "(None, 1, 1)"]
    assert insert.insert_absent(new, old, catalog.POSITION_KEY, catalog.TILL).count() == 6


def test_shuffles_are_divided_by_the_input(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        tune(spark, 1000 * INPUT_OF_PARTITION)
        assert spark.conf.get(name) == "1000"
        tune(spark)  # without a size, what is set stays
        assert spark.conf.get(name) == "1000"
        assert 0 < frames.input_bytes(spark, SF_DIR) < INPUT_OF_PARTITION
        tune(spark, frames.input_bytes(spark, SF_DIR))
        assert spark.conf.get(name) == str(own)
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("name", ["calendar", "calendar_load", "month_totals", "months", "receipts", "voids"])
def test_receipts_are_divided_by_the_input(spark, monkeypatch, name):
    """The lines of a task, and so its memory, stay the same as the tables grow."""
    monkeypatch.setattr(frames, "input_bytes", lambda *_: 777 * INPUT_OF_PARTITION)
    try:
        plan = physical(spark, name)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    parts = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)
    assert len(parts) > 1 and set(parts) == {"777"}


def test_fields_are_parsed_once(spark):
    """The filter by faults stands above the list of faults: no parsing in it."""
    plan = QUERIES["parse_rejects"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "size(" in line]
    assert len(filters) == 3 and not any("try_cast" in line.lower() or "CASE WHEN" in line for line in filters)
