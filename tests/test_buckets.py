"""Hubs and satellites in hash buckets: what a load reads, shuffles and rewrites."""

from datetime import date, datetime

import pytest
from exports import header, row
from pyspark.sql import functions as F

from tillvault.operators import vault
from tillvault.plans import jobs
from tillvault.plans.store import Load, Store, bucket_of
from tillvault.schemas import PAIRS

DAYS = [date(2024, m, 28) for m in range(1, 6)]
PAIR = PAIRS["artikel"]


def ts(day):
    return datetime(day.year, day.month, day.day, 12)


@pytest.fixture
def load(spark, drop):
    def run(store, step, *lines):
        path = drop(f"{step}.csv", header("articles"), [row("articles", **line) for line in lines])
        return jobs.run_import(spark, store, "articles", path, DAYS[step], ts(DAYS[step]))

    return run


def folders(store, table):
    return set(store.manifest()[1]["tables"][table])


def rows(store, table):
    return sorted(map(tuple, store.read(table).collect()))


def test_a_small_load_rewrites_its_buckets(spark, tmp_path, load):
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    counts = load(store, 0, *({"art_nr": str(n)} for n in range(40)))
    assert counts["artikel.stage"] == counts["artikel.hub_new"] == 40
    before = {t: folders(store, t) for t in (PAIR.hub, PAIR.sat)}
    used = {r[0] for r in store.read(PAIR.hub).select(bucket_of(8)).distinct().collect()}
    assert len(before[PAIR.hub]) == len(used) > 2

    counts = load(store, 1, {"art_nr": "7", "vk_brutto": "0,50"}, {"art_nr": "77"})
    assert (counts["artikel.stage"], counts["artikel.hub_new"], counts["artikel.sat_closed"]) == (2, 1, 1)
    touched = store.read(PAIR.hub).filter(F.col("zuletzt_gesehen") == DAYS[1]).select(bucket_of(8)).distinct().collect()
    for table in (PAIR.hub, PAIR.sat):
        new = {f for f in folders(store, table) - before[table] if "gueltig=false" not in f}
        assert {int(f.rpartition("=")[2]) for f in new} == {r[0] for r in touched} and len(new) <= 2
        kept = {int(f.rpartition("=")[2]) for f in folders(store, table) & before[table]}
        assert kept == used - {r[0] for r in touched}
    assert store.read(PAIR.hub).count() == 41 and store.read(PAIR.sat).count() == 42
    assert store.read(PAIR.sat, open_only=True).count() == 41
    # Nothing of the session's own tables is left.
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tillvault_")]


def test_rows_lie_in_the_bucket_of_their_key(spark, tmp_path, load):
    store = Store(spark, str(tmp_path / "store"), buckets=5)
    load(store, 0, *({"art_nr": str(n)} for n in range(20)))
    load(store, 1, *({"art_nr": str(n)} for n in range(10, 30)))
    for folder in folders(store, PAIR.hub):
        found = spark.read.parquet(f"{store.root}/{PAIR.hub}/{folder}")
        assert {r[0] for r in found.select(bucket_of(5)).distinct().collect()} == {int(folder.rpartition("=")[2])}
        assert len(found.inputFiles()) == 1


@pytest.mark.parametrize("table", [PAIR.hub, PAIR.sat])
def test_only_the_stage_is_shuffled(spark, tmp_path, load, table):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    load(store, 0, *({"art_nr": str(n)} for n in range(20)))
    begun = store.begin()
    try:
        stage = store.read(PAIR.hub).crossJoin(store.read(PAIR.sat).drop("hash", "quelle", "gueltig_adtm").limit(1))
        stage = stage.withColumns({"eintrag_ts": F.current_timestamp().cast("timestamp_ntz"), "export_datum": F.lit(DAYS[1])})
        stage = begun.stage("artikel", stage.select("hash", "hash_diff", "eintrag_ts", "export_datum", "quelle", *PAIR.keys, *PAIR.attributes))
        state = begun.in_buckets(table, [0, 1, 2, 3])
        merge = vault.load_hub if table == PAIR.hub else vault.load_sat
        plan = merge(state, stage, PAIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        begun.close()
    assert plan.count("Exchange hashpartitioning(hash") == 1 and "Bucketed: true" in plan
    assert "SelectedBucketsCount: 4 out of 4" in plan


def test_a_table_is_divided_anew(spark, tmp_path, load):
    root = str(tmp_path / "store")
    lines = [{"art_nr": str(n)} for n in range(12)]
    load(Store(spark, root, buckets=2), 0, *lines)
    changed = Store(spark, root, buckets=6)
    load(changed, 1, {"art_nr": "3", "vk_brutto": "0,50"})
    assert changed.manifest()[1]["buckets"][PAIR.sat] == 6
    assert all("/eimer=" in f for f in folders(changed, PAIR.hub))
    # Without a wish of its own a store keeps the number the tables have.
    load(Store(spark, root), 2, {"art_nr": "4", "vk_brutto": "0,50"})
    assert changed.manifest()[1]["buckets"][PAIR.hub] == 6

    plain = Store(spark, str(tmp_path / "plain"), buckets=1)
    load(plain, 0, *lines)
    load(plain, 1, {"art_nr": "3", "vk_brutto": "0,50"})
    load(plain, 2, {"art_nr": "4", "vk_brutto": "0,50"})
    for table in (PAIR.hub, PAIR.sat):
        assert rows(changed, table) == rows(plain, table)


def test_empty_stage_changes_nothing(spark, tmp_path, load):
    store = Store(spark, str(tmp_path / "store"), buckets=3)
    load(store, 0, {"art_nr": "1"}, {"art_nr": "2"})
    before = rows(store, PAIR.hub), rows(store, PAIR.sat)
    counts = load(store, 1)
    assert set(counts.values()) == {0} and (rows(store, PAIR.hub), rows(store, PAIR.sat)) == before


def test_counts_come_with_the_writing(spark, tmp_path):
    """A load's counts are observed: writing and counting are one job's work."""
    store = Store(spark, str(tmp_path / "store"))
    begun: Load = store.begin()
    begun.stage("viele", spark.range(1000))
    begun.stage("keine", spark.range(0))
    assert begun.rows == {"viele": 1000, "keine": 0}
    with pytest.raises(ValueError, match="at least 1"):
        Store(spark, str(tmp_path / "store"), buckets=0)
