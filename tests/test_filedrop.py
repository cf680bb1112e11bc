from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from exports import header, row
from pyspark.errors import PySparkException

from tillvault.plans.store import Store
from tillvault.streaming import filedrop


def put(drop, export, day, name, lines, encoding="cp1252"):
    return drop(f"drop/{export}/{day}/{name}.csv", header(export), lines, encoding)


def run(spark, store, root, checkpoint):
    return filedrop.run_filedrop(spark, store, root, checkpoint)


def frame(spark, *paths):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.selectExpr("path", "TIMESTAMP'2024-03-01 12:00:00' AS modificationTime")


def test_paths(spark, tmp_path):
    paths = ["file:/x/customers/31.01.2024/a.csv", "file:/x/nonsense/31.01.2024/a.csv", "file:/x/journal/2024-01-31/a.csv"]
    got = [(r.export, r.export_datum) for r in filedrop.located(frame(spark, *paths)).collect()]
    assert got == [("customers", date(2024, 1, 31)), (None, date(2024, 1, 31)), ("journal", None)]
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(filedrop.UnknownPlace, match="nonsense"):
        filedrop.import_pending(store, frame(spark, paths[1]))


def test_files_are_loaded_in_order_of_their_dates(spark, drop, tmp_path):
    store, root, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "drop"), str(tmp_path / "cp")
    # The later export is dropped first.
    put(drop, "customers", "29.02.2024", "a", [row("customers", rabatt_satz="3")])
    put(drop, "customers", "31.01.2024", "a", [row("customers", rabatt_satz="2")])
    put(drop, "journal", "29.02.2024", "j", [row("journal"), row("journal")], "utf8")
    run(spark, store, root, checkpoint)
    sat = store.read("sat_kunden_t").orderBy("gueltig_adtm").collect()
    assert [(str(r.rabatt_satz), r.gueltig_adtm, r.gueltig) for r in sat] == [
        ("2.00", date(2024, 1, 31), False),
        ("3.00", date(2024, 2, 29), True),
    ]
    assert store.read("kassenbons_t").count() == 1

    # A second run takes only what is new.
    version = store.manifest()[0]
    run(spark, store, root, checkpoint)
    assert store.manifest()[0] == version
    put(drop, "customers", "31.03.2024", "a", [row("customers", rabatt_satz="4")])
    run(spark, store, root, checkpoint)
    assert store.manifest()[0] == version + 1
    assert store.read("sat_kunden_t").count() == 3


def test_repeated_batch_is_not_loaded_twice(spark, drop, tmp_path):
    """A batch that published part of its loads and then failed is run again."""
    store = Store(spark, str(tmp_path / "store"))
    paths = [
        put(drop, "customers", "31.01.2024", "a", [row("customers", rabatt_satz="2")]),
        put(drop, "customers", "29.02.2024", "a", [row("customers", rabatt_satz="3")]),
    ]
    files = spark.createDataFrame([(p,) for p in paths], "path string").selectExpr(
        "path", "TIMESTAMP'2024-03-01 12:00:00' AS modificationTime"
    )
    assert filedrop.import_pending(store, files) == 2
    version, before = store.manifest()[0], store.read("sat_kunden_t").count()
    assert filedrop.import_pending(store, files) == 0
    assert (store.manifest()[0], store.read("sat_kunden_t").count()) == (version, before)


@pytest.mark.parametrize("max_files", [1, 2, 1000])
def test_tables_do_not_depend_on_micro_batches(spark, drop, tmp_path, max_files):
    """February is dropped first; two files of one date share a key."""
    store = Store(spark, str(tmp_path / "store"))
    for day, name, rate in (("29.02.2024", "a", "3"), ("31.01.2024", "b", "2"), ("31.01.2024", "c", "4")):
        put(drop, "customers", day, name, [row("customers", rabatt_satz=rate)])
    assert filedrop.run_filedrop(spark, store, str(tmp_path / "drop"), str(tmp_path / "cp"), max_files) == 3
    sat = store.read("sat_kunden_t").orderBy("gueltig_adtm", "gueltig_edtm").collect()
    assert [(str(r.rabatt_satz), r.gueltig_adtm, r.gueltig_edtm, r.gueltig) for r in sat] == [
        ("2.00", date(2024, 1, 31), date(2024, 1, 31), False),
        ("4.00", date(2024, 1, 31), date(2024, 2, 29), False),
        ("3.00", date(2024, 2, 29), date(2099, 12, 31), True),
    ]


def test_late_files_are_refused(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    new = put(drop, "customers", "29.02.2024", "a", [row("customers")])
    filedrop.import_pending(store, frame(spark, new))
    old = put(drop, "customers", "31.01.2024", "a", [row("customers")])
    with pytest.raises(filedrop.LateFile, match="31.01.2024"):
        filedrop.import_pending(store, frame(spark, new, old))
    assert filedrop.import_pending(store, frame(spark, new, old), on_late="skip") == 0


def test_vacuum_keeps_what_manifests_name(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n, day in enumerate(("31.01.2024", "29.02.2024", "31.03.2024")):
        path = put(drop, "customers", day, "a", [row("customers", rabatt_satz=str(n)), row("customers", kdnr="7")])
        files = spark.createDataFrame([(path,)], "path string").selectExpr("path", "TIMESTAMP'2024-04-01' AS modificationTime")
        filedrop.import_pending(store, files)
    rows = lambda v=None: sorted(map(str, store.read("sat_kunden_t", version=v).collect()))
    newest, older = rows(), rows(2)
    assert store.vacuum(keep=2) and (rows(), rows(2)) == (newest, older)
    assert store.vacuum(keep=2) == []
    store.vacuum()
    assert rows() == newest and store._versions() == [3] and not store.exists(f"{store.root}/_stage/kunden")


def test_one_of_two_loads_is_published(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    loads = [store.begin(), store.begin()]
    with ThreadPoolExecutor(2) as pool:
        outcomes = [f.exception() for f in [pool.submit(load.commit) for load in loads]]
    assert sorted(type(o).__name__ for o in outcomes) == ["ConcurrentLoad", "NoneType"]


def test_one_bad_file_does_not_stop_the_others(spark, drop, tmp_path):
    store, root, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "drop"), str(tmp_path / "cp")
    put(drop, "customers", "31.01.2024", "a", [row("customers", rabatt_satz="2")])
    put(drop, "customers", "29.02.2024", "bad", [row("customers", rabatt_satz="no number")])
    put(drop, "customers", "31.03.2024", "c", [row("customers", rabatt_satz="3")])
    drop("drop/nonsense/31.03.2024/d.csv", ["x"], [["1"]])
    for name, bon in (("j", "1"), ("k", "2")):
        put(drop, "journal", "31.03.2024", name, [row("journal", bon_nr=bon)], "utf8")
    put(drop, "journal", "31.03.2024", "l", [row("journal", bon_nr="no number")], "utf8")
    with pytest.raises(PySparkException, match="no number"):
        run(spark, store, root, checkpoint)
    assert store.read("dateien_t").count() == 1  # January, loaded before the bad file
    assert filedrop.run_filedrop(spark, store, root, checkpoint, on_bad="set_aside") == 3
    files = {r.pfad.rsplit("/", 1)[1]: (r.stand, r.grund) for r in store.read("dateien_t").collect()}
    assert {n for n, (stand, _) in files.items() if stand == "geladen"} == {"a.csv", "c.csv", "j.csv", "k.csv"}
    assert files["d.csv"] == ("zurueckgestellt", "place") and "no number" in files["bad.csv"][1]
    assert store.read("kassenbons_t").count() == 2 and store.read("sat_kunden_t").count() == 2
    # What is set aside is not tried again, and manifests hold no names of files.
    assert filedrop.run_filedrop(spark, store, root, checkpoint) == 0
    assert ".csv" not in str(store.manifest())


def test_a_run_that_stopped_goes_on(spark, drop, tmp_path, monkeypatch):
    """The second load fails after the stream has committed its batch: the next run imports the rest."""
    store, root, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "drop"), str(tmp_path / "cp")
    for n, day in enumerate(("31.01.2024", "29.02.2024", "31.03.2024")):
        put(drop, "customers", day, "a", [row("customers", rabatt_satz=str(n))])
    load, calls = filedrop._load, []

    def failing(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("lost")
        load(*args)

    monkeypatch.setattr(filedrop, "_load", failing)
    with pytest.raises(OSError, match="lost"):
        run(spark, store, root, checkpoint)
    monkeypatch.setattr(filedrop, "_load", load)
    assert store.read("sat_kunden_t").count() == 1 and filedrop.arrived(spark, checkpoint).count() == 3
    assert run(spark, store, root, checkpoint) == 2 and store.read("sat_kunden_t").count() == 3


def test_stream_that_goes_on(spark, drop, tmp_path):
    store, root, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "drop"), str(tmp_path / "cp")
    put(drop, "customers", "29.02.2024", "a", [row("customers", rabatt_satz="3")])
    put(drop, "customers", "31.01.2024", "b", [row("customers", rabatt_satz="2")])
    query = filedrop.start_filedrop(spark, store, root, checkpoint, "0 seconds")
    try:
        query.processAllAvailable()
        put(drop, "customers", "31.03.2024", "c", [row("customers", rabatt_satz="4")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert store.read("sat_kunden_t").count() == 3 and store.read("dateien_t").count() == 3
