from datetime import date, datetime
from decimal import Decimal

import pytest
from exports import header, row
from pyspark.sql import functions as F

from tillvault.functions import german
from tillvault.plans import jobs
from tillvault.plans.store import Store
from tillvault.schemas import EXPORTS
from tillvault.sources.exports import read_export
from tillvault.sources.stamp import parse_export_date


@pytest.mark.parametrize("export", sorted(EXPORTS))
def test_every_export_is_read_by_header_name(spark, drop, export):
    encoding = EXPORTS[export].encoding
    names = header(export)
    line = row(export)
    # Columns in another order, and one the export does not define.
    path = drop("f.csv", ["Extra", *reversed(names)], [["x", *reversed(line)]], encoding)
    rows = read_export(spark, export, path).collect()
    assert len(rows) == 1
    assert rows[0].asDict().keys() == {c for c, _ in EXPORTS[export].columns.values()}


def test_german_values(spark, drop):
    path = drop("a.csv", header("articles"), [row("articles", art_bez='"Käse ""mild""; 5 €"', vk_brutto="12,99")])
    got = read_export(spark, "articles", path).first()
    assert got.art_bez == 'Käse "mild"; 5 €'
    assert got.vk_brutto == Decimal("12.99")
    assert got.mengenfaktor == Decimal("1.500")
    assert got.kurzcode is None


def test_every_cp1252_character_survives(spark, drop):
    text = bytes(b for b in range(0xA0, 0x100)).decode("cp1252") + bytes(range(0x80, 0xA0)).decode("cp1252", "ignore")
    path = drop("c.csv", header("customers"), [row("customers", kd_name=text)])
    assert read_export(spark, "customers", path).first().kd_name == text


def test_missing_values(spark, drop):
    rows = [row("customers", kdnr=str(i), kd_name=t) for i, t in enumerate(["NA", "null", '""', "", "Nah"])]
    path = drop("c.csv", header("customers"), rows)
    got = {r.kdnr: r.kd_name for r in read_export(spark, "customers", path).collect()}
    assert got == {"0": None, "1": None, "2": None, "3": None, "4": "Nah"}
    only_empty = read_export(spark, "customers", path, null_texts=("",)).collect()
    assert {r.kd_name for r in only_empty} == {"NA", "null", None, "Nah"}


def test_whole_number_keys_lose_leading_zeros(spark, drop):
    rows = [row("customers", kdnr="007"), row("customers", kdnr="A07")]
    got = read_export(spark, "customers", drop("c.csv", header("customers"), rows)).collect()
    assert [r.kdnr for r in got] == ["7", "A07"]


def test_bad_numbers_are_refused(spark, drop):
    path = drop("a.csv", header("articles"), [row("articles", vk_brutto="1.234,50")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_export(spark, "articles", path).collect()
    path = drop("l.csv", header("suppliers"), [row("suppliers", lief_nr="x")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_export(spark, "suppliers", path).collect()


def test_missing_column_and_other_header_are_refused(spark, drop):
    with pytest.raises(ValueError, match="Rabattsatz"):
        read_export(spark, "customers", drop("c.csv", ["KDNR", "Name"], [["1", "x"]]))
    one = drop("1.csv", header("customers"), [row("customers")])
    other = drop("2.csv", list(reversed(header("customers"))), [list(reversed(row("customers", kdnr="2")))])
    with pytest.raises(Exception, match="(?i)header"):
        read_export(spark, "customers", [one, other]).collect()


def test_multi_ean_drops_exact_duplicates(spark, drop):
    rows = [row("multi_ean"), row("multi_ean"), row("multi_ean", ean_m="901")]
    assert read_export(spark, "multi_ean", drop("m.csv", header("multi_ean"), rows)).count() == 2


def test_file_order_over_many_splits(spark, drop):
    n = 5000
    rows = [row("journal", bon_nr=str(n - i)) for i in range(n)]
    path = drop("j.csv", header("journal"), rows, "utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        lines = read_export(spark, "journal", path, file_order=True)
        assert lines.rdd.getNumPartitions() > 5
        got = lines.select("bon_nr", "_block", "_zeile").orderBy("_block", "_zeile").collect()
        by_line = lines.select("bon_nr", "_zeile").orderBy("_zeile").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.bon_nr for r in got] == list(range(n, 0, -1))
    assert len(by_line) == n


def test_split_parts(spark):
    df = spark.createDataFrame([("BV | Artikel",), ("BV",), (None,), ("a|b|c",), ("|x",)], "t string")
    got = df.select(german.part(F.col("t"), 0), german.part(F.col("t"), 1)).collect()
    assert [tuple(r) for r in got] == [("BV ", " Artikel"), ("BV", None), (None, None), ("a", "b"), ("", "x")]


def test_export_date():
    assert parse_export_date("05.03.2024") == date(2024, 3, 5)
    with pytest.raises(ValueError):
        parse_export_date("2024-03-05")


def test_timestamps(spark, drop):
    path = drop("j.csv", header("journal"), [row("journal", bon_beginn="")], "utf8")
    got = read_export(spark, "journal", path).first()
    assert got.bon_abschluss == datetime(2024, 12, 30, 10, 5)
    assert got.bon_beginn is None


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("1,50", "decimal(18,2)", "1.50"),
        ("1,500000000000000", "decimal(18,2)", "1.50"),
        ("-12", "decimal(5,2)", "-12.00"),
        (" 7,1 ", "decimal(5,2)", "7.10"),
        ("1,2300000000004", "decimal(18,2)", None),
        ("0,0000000000000000001", "decimal(18,2)", None),
        ("1000,00", "decimal(5,2)", None),
        ("1.000,00", "decimal(18,2)", None),
        ("1e-13", "decimal(18,2)", None),
        ("x", "decimal(18,2)", None),
    ],
)
def test_decimals_are_taken_whole_or_not_at_all(spark, text, kind, value):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(german.decimal_comma(F.col("t"), kind, strict=False)).first()[0]
    assert (str(got) if got is not None else None) == value
    strict = df.select(german.decimal_comma(F.col("t"), kind))
    if value is None:
        with pytest.raises(Exception, match="does not fit|NUMERIC_VALUE_OUT_OF_RANGE|CAST_INVALID_INPUT"):
            strict.collect()
    else:
        assert str(strict.first()[0]) == value


def test_lenient_timestamps(spark):
    df = spark.createDataFrame([("30.12.2024 10:05:00",), ("31.02.2024 10:05:00",), ("2024-12-30 10:05:00",), (None,)], "t string")
    got = [r[0] for r in df.select(german.timestamp(F.col("t"), strict=False)).collect()]
    assert [str(x) for x in got] == ["2024-12-30 10:05:00", "None", "None", "None"]


def test_bad_lines_are_set_aside(spark, drop, tmp_path):
    """A short line, a long one, a field of another kind, a line without its till: the others load."""
    store = Store(spark, str(tmp_path / "store"))
    good = [row("customers", kdnr=str(n)) for n in range(3)]
    bad = [row("customers", kdnr="8")[:-1], [*row("customers", kdnr="9"), "x"], row("customers", kdnr="10", kd_name="ü", rabatt_satz="viel")]
    path = drop("c.csv", header("customers"), [good[0], *bad, *good[1:]])
    day, time = date(2024, 1, 31), datetime(2024, 1, 31)
    with pytest.raises(Exception, match="MALFORMED|viel|malformed"):
        jobs.run_import(spark, store, "customers", path, day, time)
    counts = jobs.run_import(spark, store, "customers", path, day, time, on_bad_lines="set_aside")
    assert counts["customers.bad_lines"] == 3 and counts["kunden.stage"] == 3
    lines = [";".join(line) for line in bad]
    set_aside = {r.zeile: (r.export, r.export_datum, r.fehler, r.pfad[-5:]) for r in store.read("schlechte_zeilen_t").collect()}
    assert set(set_aside) == set(lines)
    assert [set_aside[z][2] for z in lines] == ["zeile", "zeile", "rabatt_satz"] and {v[3] for v in set_aside.values()} == {"c.csv"}

    journal = [row("journal", bon_nr="1"), row("journal", bon_nr="")[:5], row("journal", bon_nr="2"), row("journal", bon_nr="")]
    path = drop("j.csv", header("journal"), journal, "utf8")
    counts = jobs.run_import(spark, store, "journal", path, day, time, on_bad_lines="set_aside")
    assert counts["journal.bad_lines"] == 2 and counts["journal.new"] == 2
    faults = {r.fehler for r in store.read("schlechte_zeilen_t").filter("export = 'journal'").collect()}
    assert "bon_nr" in faults and any(f.startswith("zeile") for f in faults)
    good_only = drop("k.csv", header("customers"), good)
    assert jobs.run_import(spark, store, "customers", good_only, day, time, on_bad_lines="set_aside")["customers.bad_lines"] == 0
