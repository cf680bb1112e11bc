"""What the plans must and must not contain."""

import re

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tillvault.operators import insert, journal
from tillvault.plans import catalog, frames
from tillvault.plans.jobs import by_month

QUERIES = catalog.catalog()


def plan_of(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_all_pairs_and_no_python(spark, name):
    plan = plan_of(spark, QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = plan_of(spark, QUERIES["key_violations"](spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
    plan = plan_of(spark, QUERIES["hub_bulk_articles"](spark, SF_DIR))
    assert re.search(r"PushedFilters: \[.*p_type,LARGE", plan)


def test_rows_are_shuffled_once_for_numbers_and_leading_positions(spark):
    """Two windows and a join over the lines share one exchange, even without broadcasts."""
    lines = frames.table(spark, SF_DIR, "lineitem").selectExpr(
        "l_returnflag AS _datei",
        "l_orderkey AS bon_nr",
        "l_suppkey AS kasse_nr",
        "l_partkey AS _zeile",
        "struct(shiftright(l_partkey, 8) AS teil) AS _block",
        "cast(l_tax AS string) AS art_nr",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = journal.number_with_leading(lines, ["_zeile"], journal.leads(F.col("art_nr")))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = plan.split("\n")
    # The rows are the left side of the topmost join: down from it to the first scan.
    top = next(i for i, line in enumerate(nodes) if "SortMergeJoin" in line and "LeftOuter" in line)
    scan = next(i for i, line in enumerate(nodes) if "FileScan" in line)
    assert sum("Window" in line for line in nodes[top:scan]) == 2
    assert sum("Exchange" in line for line in nodes[top:scan]) == 1


def test_month_writes_are_rebalanced(spark):
    df = spark.range(10).selectExpr("id", "DATE'2024-01-01' AS d")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_of(spark, by_month(df, "d"))


@pytest.mark.parametrize("name", ["receipts", "months", "calendar", "order_aid_bakery", "visits_by_hour"])
def test_receipts_are_summed_by_hash(spark, name):
    """Lines are counted by hash before anything is sorted: the lowest aggregation is no sort aggregation."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line)
    lowest = [line for line in plan[:scan] if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest and "raise_error" in "".join(plan)


def test_order_aid_reads_its_period(spark):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", plan_of(spark, QUERIES["order_aid_meat"](spark, SF_DIR)))


@pytest.mark.parametrize("name", ["asof_sale", "month_totals", "order_aid_bakery"])
def test_receipts_are_joined_by_number(spark, name):
    assert "hashpartitioning(hash_bon" not in plan_of(spark, QUERIES[name](spark, SF_DIR))


def test_existing_rows_are_filtered_before_they_are_shuffled(spark):
    """Of 100,000 receipts a file of 300 spread over their range lets few through, none of its own is lost."""
    existing = spark.range(100_000).selectExpr("cast(id % 3 AS int) AS kasse_nr", "id AS bon_nr", "cast(id % 7 AS int) AS pos")
    new = spark.range(300).selectExpr("cast(id * 337 % 3 AS int) AS kasse_nr", "id * 337 AS bon_nr")
    key = ["kasse_nr", "bon_nr"]
    passed = insert.likely(existing, new, key)
    # More than a tenth of the key range, less than a tenth of the rows.
    count = passed.count()
    own = existing.join(new, key, "left_semi")
    assert own.count() <= count <= 10_000 and own.exceptAll(passed).isEmpty()
    plan = insert.absent(new, passed, key)._jdf.queryExecution().executedPlan().toString()
    join = plan.index("BroadcastHashJoin [_bucket")
    assert "Exchange hashpartitioning(kasse_nr" not in plan[join:]
    # A filter that is full changes nothing but the work.
    for bits in (1, 15, 26):
        added = insert.absent(new, insert.likely(existing, new, key, bits), key)
        assert added.count() == 300 - own.count() == 3


def test_leading_positions_are_summed_by_hash(spark):
    """The carry's order is packed into numbers, so no step of it sorts to aggregate."""
    plan = plan_of(spark, QUERIES["leading_position"](spark, SF_DIR))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
