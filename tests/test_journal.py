"""Journal operators against brute force, and the journal import from files."""

import random
from datetime import date, datetime
from hashlib import md5

import pytest
from exports import header, row
from pyspark.sql import functions as F

from tillvault.operators import journal as till
from tillvault.operators import ordering, status
from tillvault.plans import jobs
from tillvault.plans.store import Store

TS = datetime(2025, 1, 2, 12)


def key(*parts):
    return md5(":".join(str(p) for p in parts).encode()).hexdigest()


def brute_force(lines):
    """Positions and leading positions by loops; lines: (file, till, receipt, art_nr) in file order."""
    counts, numbered = {}, []
    for file, till_nr, receipt, art in lines:
        pos = counts.get((file, receipt), 0)
        counts[file, receipt] = pos + 1
        numbered.append((file, till_nr, receipt, pos, art))
    result, last, current = {}, None, None
    for file, till_nr, receipt, pos, art in sorted(numbered, key=lambda r: r[:4]):
        if file != current:
            current, last = file, (till_nr, receipt, pos)
        if art != "-":
            last = (till_nr, receipt, pos)
        result[file, till_nr, receipt, pos] = (art, key(*last))
    return result


def make_lines(seed, n, hot_share=0.33, followers=0.5):
    rnd = random.Random(seed)
    lines = []
    for i in range(n):
        file = rnd.choice(["a", "a", "a", "b"])
        # One receipt number holds a third of the lines; others are far apart.
        receipt = 5 if rnd.random() < hot_share else rnd.choice([1, 2, 40, 16383, 16384, 70000, 10**9, 10**12])
        art = "-" if rnd.random() < followers else str(i)
        lines.append((file, rnd.choice([1, 2]), receipt, art))
    return lines


def frame(spark, lines, block_rows):
    rows = [(f, t, b, a or None, i) for i, (f, t, b, a) in enumerate(lines)]
    df = spark.createDataFrame(rows, "_datei string, kasse_nr int, bon_nr long, art_nr string, _zeile long")
    return df.withColumn(ordering.BLOCK, F.struct(F.floor(F.col("_zeile") / block_rows).alias("teil"))).repartition(5)


@pytest.mark.parametrize("block_rows,bucket_bits", [(7, 20), (7, 3), (1000, 14)])
@pytest.mark.parametrize("seed,followers", [(1, 0.5), (2, 0.97), (3, 1.0), (4, 0.0)])
def test_numbers_and_leading_positions(spark, monkeypatch, seed, followers, block_rows, bucket_bits):
    monkeypatch.setattr(ordering, "BUCKET_BITS", bucket_bits)
    lines = make_lines(seed, 400, followers=followers)
    df = frame(spark, lines, block_rows)
    got = till.number_with_leading(df, ["_zeile"], till.leads(F.col("art_nr"))).collect()
    expected = brute_force(lines)
    assert len(got) == len(lines)
    assert {(r._datei, r.kasse_nr, r.bon_nr, r.pos): (r.art_nr, r.hash_fuehrend) for r in got} == expected
    assert all(r.hash == key(r.kasse_nr, r.bon_nr, r.pos) for r in got)

    numbered = till.number_positions(df, ["_zeile"]).collect()
    assert {(r._datei, r.kasse_nr, r.bon_nr, r.pos, r.art_nr) for r in numbered} == {
        (*k, v[0]) for k, v in expected.items()
    }


def test_sparse_receipt_numbers(spark, monkeypatch):
    """Receipt numbers all over 63 bits, in a deep tree."""
    monkeypatch.setattr(ordering, "BUCKET_BITS", 4)
    monkeypatch.setattr(ordering, "FAN", 12)
    rnd = random.Random(5)
    numbers = [rnd.randrange(1 << rnd.choice([8, 30, 50, 63])) for _ in range(60)]
    lines = [("a", rnd.choice([1, 2, 3]), rnd.choice(numbers), rnd.choice("-----x")) for _ in range(300)]
    got = till.number_with_leading(frame(spark, lines, 50), ["_zeile"], till.leads(F.col("art_nr"))).collect()
    assert {(r._datei, r.kasse_nr, r.bon_nr, r.pos): (r.art_nr, r.hash_fuehrend) for r in got} == brute_force(lines)


def test_numbers_per_till(spark):
    lines = make_lines(9, 300)
    got = till.number_positions(frame(spark, lines, 11), ["_zeile"], per_till=True).collect()
    groups = {}
    for r in sorted(got, key=lambda r: r._zeile):
        groups.setdefault((r._datei, r.kasse_nr, r.bon_nr), []).append(r.pos)
    assert all(places == list(range(len(places))) for places in groups.values())


def test_null_article_number_leads(spark):
    df = frame(spark, [("a", 1, 1, "x"), ("a", 1, 1, ""), ("a", 1, 1, "-")], 10)
    got = till.number_with_leading(df, ["_zeile"], till.leads(F.col("art_nr"))).orderBy("pos").collect()
    assert [r.hash_fuehrend for r in got] == [key(1, 1, 0), key(1, 1, 1), key(1, 1, 1)]


def test_hot_groups_get_blocks(spark):
    lines = [("a", 1, 5 if i % 3 else i, str(i)) for i in range(300)]
    df = frame(spark, lines, 10).drop(ordering.BLOCK)
    blocked = ordering.block_hot_groups(df, ["bon_nr"], {"teil": F.shiftright("_zeile", 4)}, hot_rows=50)
    blocks = {r.bon_nr: r.n for r in blocked.groupBy("bon_nr").agg(F.count_distinct("_block").alias("n")).collect()}
    assert blocks[5] > 10 and all(n == 1 for b, n in blocks.items() if b != 5)
    got = till.number_positions(blocked, ["_zeile"], (), F.col("_heiss")).filter("bon_nr = 5").orderBy("_zeile")
    assert [r.pos for r in got.collect()] == list(range(200))


def journal_frame(spark, rows):
    """rows: (till, receipt, typ, header amount)"""
    df = spark.createDataFrame(rows, "kasse_nr int, bon_nr long, bon_typ string, bon_summe int")
    df = df.withColumn("bon_summe", F.col("bon_summe").cast("decimal(18,2)"))
    ts = F.lit("2024-12-30 10:00:00").cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    return df.withColumns(
        {"eintrag_ts": ts, "bon_beginn": ts, "bon_abschluss": ts, "kdnr": none, "tse_info": none, "storno_ref": none}
    )


def test_receipt_type(spark):
    rows = [(1, 1, "RN", 1), (1, 1, "BV", 1), (1, 2, "RN", 1), (2, 1, "BV", 1), (1, 3, None, 1), (1, 3, "RN", 1)]
    got = till.receipts(journal_frame(spark, rows)).collect()
    assert {(r.kasse_nr, r.bon_nr): r.bon_typ for r in got} == {
        (1, 1): "BV",
        (1, 2): "RN",
        (2, 1): "BV",
        (1, 3): None,
    }
    assert all(r.hash == key(r.kasse_nr, r.bon_nr) and r.bon_datum == date(2024, 12, 30) for r in got)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, 4, "BV", 1), (1, 4, "XX", 1)],
        [(1, 4, "BV", 1), (1, 4, None, 1)],
        [(1, 4, "BV", 1), (1, 4, "BV", 2)],
        [(1, 4, "BV", 1), (1, 4, "RN", 2)],
    ],
)
def test_receipt_conflicts(spark, rows):
    df = journal_frame(spark, [*rows, (1, 5, "BV", 1)])
    with pytest.raises(Exception, match="kasse_nr=1, bon_nr=4"):
        till.receipts(df).collect()
    # Whatever columns are read.
    for columns in (["bon_datum"], ["kasse_nr"]):
        with pytest.raises(Exception, match="bon_nr=4"):
            till.receipts(df).select(*columns).collect()
    with pytest.raises(Exception, match="bon_nr=4"):
        till.calendar_days(till.receipts(df)).collect()
    flagged = {r.bon_nr: r.widerspruch for r in till.receipts(df, on_conflict="flag").collect()}
    assert flagged == {4: True, 5: False}


def test_groups_of_cash_movements(spark):
    cases = [
        ("WGR fehlt", "Einzahlung bar", "5.00", "9001:1"),
        ("wgr FEHLT", "AUSZAHLUNG", "-5.00", "9001:2"),
        ("WGR fehlt", "Einzahlung bar", "0.00", "0:0"),
        ("WGR fehlt", None, "5.00", "0:0"),
        ("10:2 | Backwaren", "Einzahlung", "5.00", "10:2"),
        (None, "Einzahlung", "5.00", None),
        ("fehlt | ?", "Brot", "2.00", "0:0"),
    ]
    df = spark.createDataFrame(
        [(i, *c[:2], c[2]) for i, c in enumerate(cases)], "i int, warengruppe string, art_bez string, p string"
    )
    df = df.withColumn("preis_gesamt", F.col("p").cast("decimal(18,2)"))
    df = df.withColumns({"ma": F.lit(" 12 | Anna"), "kasse_nr": F.lit(1), "bon_nr": F.lit(2)})
    got = till.with_group(df).orderBy("i").collect()
    assert [r.wgr for r in got] == [c[3] for c in cases]
    assert got[4].wgr_bez == "Backwaren" and got[0].wgr_bez is None and got[0].ma_id == '12'
    assert got[0].hash_bon == key(1, 2)


def test_calendar(spark):
    days = [date(2024, 12, 30), date(2024, 12, 29), date(2021, 1, 3), date(2024, 12, 30)]
    df = spark.createDataFrame([(d,) for d in days], "bon_datum date")
    got = {r.datum: tuple(r)[1:] for r in till.calendar_days(df).collect()}
    # The year is the calendar year, the week the ISO week.
    assert got == {d: (d.year, d.month, d.day, d.isoweekday(), d.isocalendar()[1]) for d in days}
    old = till.calendar_days(df.filter("bon_datum < '2024-01-01'"))
    assert till.load_calendar(old, df).count() == 3


# --- imports from files -----------------------------------------------------------

LINES = [
    row("journal", art_nr="-", bon_nr="1"),
    row("journal", bon_nr="1", typ="RN | Text"),
    row("journal", bon_nr="1", art_nr="-", mengenfaktor="", kdnr="100"),
    row("journal", bon_nr="2", typ="RN", bon_beginn="", kdnr=""),
    row("journal", bon_nr="2", kasse_nr="2", bon_abschluss="31.12.2024 09:00:00", bon_beginn=""),
    row("journal", bon_nr="2", typ="RN", bon_beginn="", kdnr="", art_nr="-"),
    row("journal", bon_nr="3", warengruppe="Warengruppe fehlt", art_bez="Einzahlung", preis_gesamt="20,00"),
]


@pytest.fixture
def loaded(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    path = drop("j1.csv", header("journal"), LINES, "utf8")
    # Imports run as they do outside the tests: with compiled stages.
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    counts = jobs.run_import(spark, store, "journal", path, date(2025, 1, 1), TS)
    yield store, counts, path
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_journal_import(spark, loaded):
    store, counts, _ = loaded
    assert counts == {"journal.stage": 7, "journal.new": 7, "receipts.new": 4, "calendar.new": 2}
    rows = {(r.kasse_nr, r.bon_nr, r.pos): r for r in store.read("kassenjournal_t").collect()}
    assert set(rows) == {(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 0), (2, 2, 1), (1, 2, 2), (1, 3, 0)}
    one = rows[1, 1, 2]
    assert (one.mengenfaktor, one.kdnr, one.bon_typ, one.pos_typ) == (1, "100", "BV", "Artikel")
    assert rows[1, 2, 0].kdnr == "0" and rows[1, 2, 0].pos_typ is None
    assert rows[1, 2, 0].bon_beginn == rows[1, 2, 0].bon_abschluss
    assert str(one.mwst_satz) == "7.00" and str(one.menge) == "2.000" and one.eintrag_ts == TS

    bons = {(r.kasse_nr, r.bon_nr): r for r in store.read("kassenbons_t").collect()}
    assert {k: r.bon_typ for k, r in bons.items()} == {(1, 1): "BV", (1, 2): "RN", (2, 2): "BV", (1, 3): "BV"}
    positions = {(r.kasse_nr, r.bon_nr, r.pos): r for r in store.read("kassenbons_pos_t").collect()}
    leading = {k: r.hash_fuehrend for k, r in positions.items()}
    assert leading == {
        (1, 1, 0): key(1, 1, 0),
        (1, 1, 1): key(1, 1, 1),
        (1, 1, 2): key(1, 1, 1),
        (1, 2, 0): key(1, 2, 0),
        (1, 2, 2): key(1, 2, 0),
        (1, 3, 0): key(1, 3, 0),
        (2, 2, 1): key(2, 2, 1),
    }
    assert positions[1, 3, 0].wgr == "9001:1" and positions[1, 1, 0].wgr == "10:2" and positions[1, 1, 0].ma_id == '5'
    assert {p.hash_bon for p in positions.values()} == {b.hash for b in bons.values()}
    assert sorted((r.datum, r.wtag, r.kw) for r in store.read("kalender_t").collect()) == [
        (date(2024, 12, 30), 1, 1),
        (date(2024, 12, 31), 2, 1),
    ]
    assert jobs.loaded_months(store) == ["2024-12"]
    assert jobs.last_change(store) == TS


def test_months_are_read_from_folders(spark, loaded):
    store, _, _ = loaded
    months = store.months("kassenbons_t")
    want = [r[0] for r in status.loaded_months(store.read("kassenbons_t")).collect()]
    assert [r[0] for r in months.collect()] == want == jobs.loaded_months(store)
    assert "ReadSchema: struct<>" in months._jdf.queryExecution().executedPlan().toString()


def test_same_file_again_adds_nothing(spark, loaded):
    store, _, path = loaded
    later = datetime(2025, 2, 1, 12)
    counts = jobs.run_import(spark, store, "journal", path, date(2025, 2, 1), later)
    assert counts["journal.new"] == counts["receipts.new"] == counts["calendar.new"] == 0
    assert store.read("kassenjournal_t").count() == 7
    assert jobs.last_change(store) == TS


def test_overlapping_file_adds_the_rest(spark, loaded, drop):
    store, _, _ = loaded
    lines = [LINES[0], LINES[1], *[row("journal", bon_nr="9", bon_abschluss="02.01.2025 08:00:00")] * 2]
    path = drop("j2.csv", header("journal"), lines, "utf8")
    counts = jobs.run_import(spark, store, "journal", path, date(2025, 2, 1), datetime(2025, 2, 1))
    assert counts == {"journal.stage": 4, "journal.new": 2, "receipts.new": 1, "calendar.new": 1}
    assert jobs.loaded_months(store) == ["2024-12", "2025-01"]
    # months are folders, so a month's query reads only its own files
    january = store.read("kassenbons_t", months=("2025-01", "2025-01"))
    assert january.count() == 1
    assert "PartitionFilters: [isnotnull(monat" in january._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_batch_of_files_equals_files_one_by_one(spark, drop, tmp_path):
    first = drop("j1.csv", header("journal"), LINES, "utf8")
    lines = [row("journal", bon_nr="3", art_nr="-"), row("journal", bon_nr="3", art_nr="-"), row("journal", bon_nr="4")]
    second = drop("j2.csv", header("journal"), lines, "utf8")
    one, many = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "many"))
    for path in (first, second):
        jobs.run_import(spark, one, "journal", path, date(2025, 1, 1), TS)
    jobs.run_import(spark, many, "journal", [second, first], date(2025, 1, 1), TS)
    for table in ("kassenjournal_t", "kassenbons_t", "kassenbons_pos_t", "kalender_t"):
        assert sorted(map(str, one.read(table).collect())) == sorted(map(str, many.read(table).collect())), table


def test_conflicting_receipt_stops_the_load(spark, drop, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    lines = [row("journal", typ="BV"), row("journal", typ="XY")]
    with pytest.raises(Exception, match="bon_nr=1"):
        jobs.run_import(spark, store, "journal", drop("j.csv", header("journal"), lines, "utf8"), date(2025, 1, 1), TS)
    assert store.manifest()[0] == 0 and store.read("kassenjournal_t").isEmpty()


def test_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert jobs.loaded_months(store) == []
    assert jobs.last_change(store) is None
    assert jobs.last_file(store, "customers") is None
