"""Master imports from files: new, unchanged, missing and changed keys, per export."""

from datetime import date, datetime

import pytest
from exports import header, row
from pyspark.sql import functions as F

from tillvault.operators.guards import KeyViolation
from tillvault.plans import jobs
from tillvault.plans.store import Store
from tillvault.schemas import EXPORTS, PAIRS

OPEN_DATE, OPEN_TS = date(2099, 12, 31), datetime(2099, 12, 31, 23, 59, 59)
DAYS = [date(2024, m, 28) for m in range(1, 6)]


def ts(day):
    return datetime(day.year, day.month, day.day, 12)


# export -> (how a key is set, which value changes)
CASES = {
    "articles": ("art_nr", ("vk_brutto", "0,50")),
    "customers": ("kdnr", ("rabatt_satz", "5")),
    "suppliers": ("lief_nr", ("lief_name", "Neu")),
    "multi_ean": ("ean_m", ("ean_h", "4712")),
    "deposits": ("art_nr", ("pfand_brutto", "3,30")),
    "press_articles": ("art_nr", ("vk_brutto", "2,20")),
    "supplier_articles": ("ean", ("ek_netto", "0,400")),
    "groups": ("wgr", ("wgr_bez", "Neu")),
}


@pytest.mark.parametrize("export", sorted(CASES))
def test_three_imports_and_after(spark, drop, tmp_path, export):
    key, (changing, value) = CASES[export]
    other = {"articles": "0,60", "press_articles": "2,40", "supplier_articles": "0,500", "deposits": "3,50"}
    value_2 = other.get(export, "9")
    store = Store(spark, str(tmp_path / "store"))
    pair = PAIRS[EXPORTS[export].targets[0].pair]

    def load(step, *lines):
        path = drop(f"{step}.csv", header(export), [row(export, **line) for line in lines])
        return jobs.run_import(spark, store, export, path, DAYS[step], ts(DAYS[step]))

    def state():
        hub = {r.hash: r for r in store.read(pair.hub).collect()}
        sat = store.read(pair.sat).orderBy("hash", "gueltig_adtm").collect()
        keys = {r[key].split(":")[0]: h for h, r in hub.items()}
        return hub, sat, keys

    # 1: two new keys
    counts = load(0, {key: "1"}, {key: "2"})
    hub, sat, keys = state()
    assert counts[f"{pair.name}.hub_new"] == 2
    assert len(hub) == 2 and len(sat) == 2
    for r in sat:
        assert (r.gueltig, r.gueltig_adtm, r.gueltig_edtm) == (True, DAYS[0], OPEN_DATE)
        assert (r.eintrag_ats, r.eintrag_ets) == (ts(DAYS[0]), OPEN_TS)
        assert r.quelle == EXPORTS[export].quelle

    # 2: one known and unchanged, one new, one missing
    counts = load(1, {key: "1"}, {key: "3"})
    hub, sat, keys = state()
    assert len(hub) == 3 and len(sat) == 3 and all(r.gueltig for r in sat)
    assert counts[f"{pair.name}.sat_closed"] == 0
    assert hub[keys["1"]].gueltig_adtm == DAYS[0]
    assert hub[keys["1"]].zuletzt_gesehen == DAYS[1]
    assert hub[keys["2"]].zuletzt_gesehen == DAYS[0]
    assert hub[keys["3"]].eintrag_ats == ts(DAYS[1])

    # 3: one changed
    counts = load(2, {key: "1", changing: value}, {key: "3"})
    hub, sat, keys = state()
    mine = [r for r in sat if r.hash == keys["1"]]
    assert counts[f"{pair.name}.sat_closed"] == 1
    assert [(r.gueltig, r.gueltig_adtm, r.gueltig_edtm) for r in mine] == [
        (False, DAYS[0], DAYS[2]),
        (True, DAYS[2], OPEN_DATE),
    ]
    assert mine[0].eintrag_ets == ts(DAYS[2])
    assert mine[0].hash_diff != mine[1].hash_diff
    assert len(sat) == 4

    # 4: changed again; the first version keeps its end
    load(3, {key: "1", changing: value_2})
    _, sat, _ = state()
    mine = [r for r in sat if r.hash == keys["1"]]
    assert [r.gueltig_edtm for r in mine] == [DAYS[2], DAYS[3], OPEN_DATE]

    # 5: the same file again changes nothing in the satellite
    before = store.read(pair.sat).collect()
    load(4, {key: "1", changing: value_2})
    after = store.read(pair.sat).collect()
    assert sorted(before, key=str) == sorted(after, key=str)
    assert store.read(pair.sat).filter("gueltig").groupBy("hash").count().filter("count > 1").isEmpty()
    assert jobs.last_file(store, export) == DAYS[4]


def test_press_articles_feed_two_pairs(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = [row("press_articles", art_nr=str(i), mwst_kz=k) for i, k in enumerate("9407", start=1)]
    jobs.run_import(spark, store, "press_articles", drop("p.csv", header("press_articles"), lines), DAYS[0], ts(DAYS[0]))
    sat = {r.scs_pool_id: r for r in store.read("sat_artikel_t").collect()}
    assert [sat[i].wgr for i in (1, 2, 3, 4)] == ["9999:0", "9998:0", "9997:0", ""]
    one = sat[1]
    assert (one.idx, one.mengenfaktor, one.preiseinheit, one.preisgebunden_kz, one.rabatt_kz) == (0, 1, 1, "J", "N")
    assert one.kurzcode is None
    hub = store.read("hub_scs_liefart_t").collect()
    assert {(r.ean, r.lief_nr) for r in hub} == {(str(i), "34") for i in (1, 2, 3, 4)}
    assert {r.lief_art_nr for r in store.read("sat_scs_liefart_t").collect()} == {"1", "2", "3", "4"}
    assert jobs.last_file(store, "press_articles") == DAYS[0]
    assert jobs.last_file(store, "articles") is None


def test_two_sources_in_one_satellite(spark, drop, tmp_path):
    """The two exports hash different columns, so an article in both changes with each load."""
    store = Store(spark, str(tmp_path / "store"))
    article = drop("a.csv", header("articles"), [row("articles", art_nr="77")])
    press = drop("p.csv", header("press_articles"), [row("press_articles", art_nr="77")])
    for day, (export, path) in zip(DAYS, [("articles", article), ("press_articles", press), ("articles", article)]):
        jobs.run_import(spark, store, export, path, day, ts(day))
    sat = store.read("sat_artikel_t").orderBy("gueltig_adtm").collect()
    assert [r.quelle for r in sat] == ["scs_export_artikel", "scs_export_presseartikel", "scs_export_artikel"]
    assert [r.gueltig for r in sat] == [False, False, True]
    # the hub keeps the first source
    assert jobs.last_file(store, "articles") == DAYS[2]
    assert jobs.last_file(store, "press_articles") is None


def test_price_unit_default_is_no_change(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for day in DAYS[:2]:
        path = drop(f"{day}.csv", header("articles"), [row("articles", preiseinheit="0")])
        jobs.run_import(spark, store, "articles", path, day, ts(day))
    sat = store.read("sat_artikel_t").collect()
    assert [(r.preiseinheit, r.gueltig_adtm) for r in sat] == [(1, DAYS[0])]


def test_composite_group_code(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = [row("articles"), row("articles", art_nr="2", uwgr="")]
    jobs.run_import(spark, store, "articles", drop("a.csv", header("articles"), lines), DAYS[0], ts(DAYS[0]))
    assert {r.wgr for r in store.read("sat_artikel_t").collect()} == {"10:2", None}
    groups = [row("groups", mwst_kz=k, uwgr=str(i)) for i, k in enumerate(["4", "9", "5", ""])]
    jobs.run_import(spark, store, "groups", drop("g.csv", header("groups"), groups), DAYS[0], ts(DAYS[0]))
    rates = store.read("hub_warengruppen_t").join(store.read("sat_warengruppen_t"), "hash")
    assert {r.wgr: str(r.mwst_satz) for r in rates.collect()} == {
        "10:0": "19.00",
        "10:1": "7.00",
        "10:2": "0.00",
        "10:3": "0.00",
    }


def test_deposits_without_article_are_left_out(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = [row("deposits"), row("deposits", art_nr=""), row("deposits", art_nr="")]
    counts = jobs.run_import(spark, store, "deposits", drop("d.csv", header("deposits"), lines), DAYS[0], ts(DAYS[0]))
    assert counts["pfand.stage"] == 1


def test_bad_keys_stop_the_load_or_are_set_aside(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    # One additional barcode with two main ones, and a good one.
    lines = [row("multi_ean", ean_m="1", ean_h=h) for h in ("7", "8")] + [row("multi_ean", ean_m="2")]
    path = drop("m.csv", header("multi_ean"), lines)
    with pytest.raises(KeyViolation, match="mean"):
        jobs.run_import(spark, store, "multi_ean", path, DAYS[0], ts(DAYS[0]))
    assert store.manifest()[0] == 0 and store.read("hub_mean_t").isEmpty()

    null_key = drop("a.csv", header("articles"), [row("articles", art_nr="")])
    with pytest.raises(KeyViolation, match="None"):
        jobs.run_import(spark, store, "articles", null_key, DAYS[0], ts(DAYS[0]))

    counts = jobs.run_import(spark, store, "multi_ean", path, DAYS[0], ts(DAYS[0]), on_bad_keys="quarantine")
    assert counts["mean.quarantine"] == 2 and counts["mean.stage"] == 1
    assert [r.ean_m for r in store.read("hub_mean_t").collect()] == ["2"]


def test_all_versions_scope(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for day, price in zip(DAYS[:3], ("1,00", "2,00", "3,00")):
        path = drop(f"{day}.csv", header("articles"), [row("articles", vk_brutto=price)])
        counts = jobs.run_import(spark, store, "articles", path, day, ts(day), close_scope="all_versions")
    sat = store.read("sat_artikel_t").orderBy("gueltig_adtm").collect()
    assert [r.gueltig_edtm for r in sat] == [DAYS[2], DAYS[2], OPEN_DATE]
    assert counts["artikel.sat_closed"] == 2


def test_failed_load_changes_nothing(spark, drop, tmp_path):
    """Both stages of the press export are checked before any table is written."""
    store = Store(spark, str(tmp_path / "store"))
    good = drop("1.csv", header("press_articles"), [row("press_articles")])
    jobs.run_import(spark, store, "press_articles", good, DAYS[0], ts(DAYS[0]))
    before = {t: store.read(t).collect() for t in ("hub_artikel_t", "sat_artikel_t", "hub_scs_liefart_t")}
    bad = drop("2.csv", header("press_articles"), [row("press_articles", art_nr="abc")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        jobs.run_import(spark, store, "press_articles", bad, DAYS[1], ts(DAYS[1]))
    assert before == {t: store.read(t).collect() for t in before}
    assert store.read("hub_artikel_t").select(F.max("zuletzt_gesehen")).first()[0] == DAYS[0]


def test_concurrent_loads_do_not_overwrite_each_other(spark, tmp_path):
    from tillvault.plans.store import ConcurrentLoad

    store = Store(spark, str(tmp_path / "store"))
    first, second = store.begin(), store.begin()
    first.commit()
    with pytest.raises(ConcurrentLoad):
        second.commit()


def test_no_digit_is_lost(spark, drop, tmp_path):
    """A price of four decimals is a change; a factor of 1000 loads; what does not fit stops the load."""
    store = Store(spark, str(tmp_path / "store"))
    for n, price in enumerate(("1,2341", "1,2344")):
        path = drop(f"{n}.csv", header("supplier_articles"), [row("supplier_articles", ek_netto=price)])
        jobs.run_import(spark, store, "supplier_articles", path, date(2024, 1 + n, 1), datetime(2024, 1 + n, 1))
    assert store.read(PAIRS["scs_liefart"].sat).count() == 2
    path = drop("a.csv", header("articles"), [row("articles", gpfaktor="1000,0")])
    jobs.run_import(spark, store, "articles", path, date(2024, 1, 1), datetime(2024, 1, 1))
    path = drop("b.csv", header("articles"), [row("articles", vk_brutto="1,999")])
    with pytest.raises(Exception, match="does not fit"):
        jobs.run_import(spark, store, "articles", path, date(2024, 2, 1), datetime(2024, 2, 1))


def test_missing_part_of_a_key_is_refused(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = drop("a.csv", header("supplier_articles"), [row("supplier_articles", ean=""), row("supplier_articles")])
    load = lambda **options: jobs.run_import(
        spark, store, "supplier_articles", path, date(2024, 1, 1), datetime(2024, 1, 1), **options
    )
    with pytest.raises(KeyViolation, match="ean=None"):
        load()
    assert load(on_bad_keys="quarantine")["scs_liefart.quarantine"] == 1
    with pytest.raises(ValueError, match="no quarantine"):
        jobs.run_import(spark, store, "journal", path, date(2024, 1, 1), datetime(2024, 1, 1), on_bad_keys="quarantine")
