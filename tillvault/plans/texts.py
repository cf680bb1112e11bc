"""Export texts as the till writes them, made from the driver's tables.

German decimals and dates, padded numbers, texts for missing values, and cp1252
characters as they arrive when read as ISO-8859-1. Spark expressions by header; the
SQL counterparts in ``oracles`` give the typed values without these texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillvault.plans.frames import table
from tillvault.schemas import EXPORTS


def comma(amount: str, kind: str = "decimal(18,2)") -> str:
    return f"replace(cast(cast({amount} AS {kind}) AS string), '.', ',')"


def _stamp(when: str) -> str:
    return f"date_format({when}, 'dd.MM.yyyy HH:mm:ss')"


_CLOSED = "o_orderdate + make_dt_interval(0, cast(8 + o_custkey % 12 AS int))"

# Export -> (tables, header -> text). Headers not listed are empty.
TEXTS: dict[str, tuple[str, dict[str, str]]] = {
    "articles": (
        "part",
        {
            "SCSPoolID": "p_partkey",
            "Strichcode": "concat('00', p_partkey)",
            "Index": "' 0 '",
            "Bezeichnung": "concat(p_name, char(128))",
            "Mengenfaktor": "'1,5'",
            "VKPreis": comma("p_retailprice"),
            "Preiseinheit": "if(p_size > 40, 'NA', string(p_size))",
            "Kurzcode": "p_type",
            "Bontext": "'null'",
            "Mengeneinheit": "'Stk'",
            "GPFaktor": "'1000,0'",
            "WGR": "p_brand",
            "UWGR": "p_size",
            "RabattKZ": "'J'",
            "PreisgebundenKZ": "'N'",
            "FSKKZ": "'n/a'",
            "Notizen": "concat('A', char(150), 'B')",
        },
    ),
    "customers": (
        "customer",
        {
            "KDNR": "lpad(c_custkey, 10, '0')",
            "Name": "if(c_nationkey = 3, 'NULL', concat(c_name, ' M', char(252), 'ller'))",
            "Rabattsatz": comma("c_nationkey * 0.25BD", "decimal(5,2)"),
        },
    ),
    "suppliers": (
        "supplier",
        {
            "LiefNr": "concat(' 0', s_suppkey)",
            "KDNR": "concat('K', s_suppkey)",
            "Name": "s_name",
            "EKArtikeluebernahme": "s_nationkey",
            "IsHauptLief": "if(s_acctbal > 0, 'J', 'N')",
            "Artikelimport-Logik": "'#N/A'",
        },
    ),
    "multi_ean": ("lineitem", {"Mehrfach-EAN": "l_partkey * 10 + 1", "Haupt-EAN": "l_partkey"}),
    "deposits": (
        "part",
        {
            "Bezeichnung": "p_name",
            "Wert": comma("p_retailprice"),
            "Hinweispflicht": "'J'",
            "WGR": "p_brand",
            "UWGR": "p_size",
            "WGR-Bezeichnung": "concat(p_brand, char(140))",
            "Strichcode": "if(p_type = 'SMALL', string(p_partkey), '')",
        },
    ),
    "press_articles": (
        "part",
        {
            "PrStrichcode": "p_partkey",
            "Titel": "p_name",
            "EKPreis": comma("cast(p_retailprice AS decimal(18,2)) * 0.01BD", "decimal(18,4)"),
            "VKPreis": comma("p_retailprice"),
            "MwStID": "p_size % 4",
            "IsFSK": "'N'",
        },
    ),
    "supplier_articles": (
        "lineitem",
        {
            "LiefArtNr": "concat(l_partkey, '-', l_suppkey)",
            "EAN": "l_partkey",
            "LiefNr": "l_suppkey",
            "EKPreis": comma("l_extendedprice"),
        },
    ),
    "groups": (
        "part",
        {
            "WGR_NR": "p_brand",
            "UWGR-NR": "lpad(p_size, 4, '0')",
            "Bezeichnung": "p_brand",
            "MwSt.-KZ": "concat('0', p_size % 3)",
            "Rabatt": "if(p_size < 25, 'J', '')",
            "FSKKZ": "'N'",
        },
    ),
    "journal": (
        "lineitem orders",
        {
            "Kassen-Nr.": "o_custkey % 3 + 1",
            "Bon-Nr.": "l_orderkey",
            "Zeitpunkt": _stamp(_CLOSED),
            "Beginn": f"if(o_orderstatus = 'F', '', {_stamp(f'{_CLOSED} - INTERVAL 5 MINUTE')})",
            "Verkäufer": "concat('A', o_custkey % 50, ' | Kasse')",
            "Kunden-Nr.": "if(o_orderpriority = '1-URGENT', '', string(o_custkey))",
            "Bon-Summe": comma("o_totalprice"),
            "Typ": "if(l_returnflag = 'R', 'RN | Position', 'BV')",
            "Artikelnummer": "if(l_returnflag = 'R', '-', string(l_partkey))",
            "Bezeichnung": "concat('Artikel ', l_partkey)",
            "Warengruppe": "concat(l_suppkey, ':0 | Gruppe')",
            "MwSt.-Satz": comma("round(l_tax * 100)", "decimal(5,2)"),
            "Mengenfaktor": "if(l_linestatus = 'F', '', '1')",
            "Menge": comma("l_quantity", "decimal(18,3)"),
            "Preis": comma("l_extendedprice"),
            "Gesamt": comma("if(l_returnflag = 'R', -l_extendedprice, l_extendedprice)"),
            "Infotext": "'None'",
            "Stornoreferenz": "'NaN'",
            "TSE-Info": "o_orderstatus",
        },
    ),
}


def export_texts(spark: SparkSession, sf_dir: str, export: str) -> DataFrame:
    """One row of texts per line of the export, under the export's headers."""
    names, texts = TEXTS[export]
    first, *more = (table(spark, sf_dir, name) for name in names.split())
    rows = first
    for other in more:
        rows = rows.join(other, rows["l_orderkey"] == other["o_orderkey"])
    return rows.selectExpr(*(f"cast({texts.get(header, repr(''))} AS string) AS `{header}`" for header in EXPORTS[export].columns))


# Export -> header -> (when, text): fields that a till could not have written.
FAULTY: dict[str, dict[str, tuple[str, str]]] = {
    "articles": {
        "VKPreis": ("p_size > 45", "'1,999'"),
        "Mengenfaktor": ("p_size = 7", "'1,0000000000001'"),
        "Index": ("p_type = 'SMALL'", "'eins'"),
        "Bezeichnung": ("p_size = 8", "'?'"),
    },
    "customers": {"Rabattsatz": ("c_acctbal > 5000", comma("c_acctbal"))},
    "journal": {
        "Zeitpunkt": ("l_tax = 0.07D", f"date_format({_CLOSED}, 'yyyy-MM-dd HH:mm:ss')"),
        "Bon-Nr.": ("l_quantity = 3", "concat('B', l_orderkey)"),
        "Menge": ("l_discount = 0.05D", "'1.000,5'"),
    },
}


def faulty_texts(spark: SparkSession, sf_dir: str, export: str) -> DataFrame:
    """``export_texts`` with some fields that are not of their kind."""
    names, texts = TEXTS[export]
    first, *more = (table(spark, sf_dir, name) for name in names.split())
    rows = first
    for other in more:
        rows = rows.join(other, rows["l_orderkey"] == other["o_orderkey"])
    fields = {header: texts.get(header, repr("")) for header in EXPORTS[export].columns}
    for header, (when, text) in FAULTY[export].items():
        fields[header] = f"if({when}, {text}, cast({fields[header]} AS string))"
    return rows.selectExpr(*(f"cast({text} AS string) AS `{header}`" for header, text in fields.items()))
