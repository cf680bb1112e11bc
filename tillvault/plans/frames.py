"""Export rows made from the driver's order tables.

Every master export exists in three snapshots. Snapshot 1 lacks some keys
(they appear later), snapshot 2 lacks others (they vanish and come back) and
has changed values; snapshot 3 is the whole table with further changes. Which
rows are concerned depends on their attributes, by SQL conditions that the
oracles use as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillvault.functions.keys import MISSING
from tillvault.operators import journal as till
from tillvault.operators import staging
from tillvault.operators.ordering import HOT_ROWS, block_hot_groups
from tillvault.operators.vault import BY_HASH
from tillvault.schemas import PAIRS
from tillvault.sources.stamp import load_time

DATES = (date(2023, 1, 31), date(2023, 2, 28), date(2023, 3, 31))
SALE_DATES = (date(1996, 1, 31), date(1998, 2, 28), date(2000, 3, 31))
JOURNAL_TS = datetime(2023, 4, 1, 12)
RELOAD_TS = datetime(2023, 5, 1, 12)


def load_time_of(day: date) -> datetime:
    return datetime.combine(day, time(12))


@dataclass(frozen=True)
class Input:
    """How an export is made: its table, rows as a function of the price step, and
    the conditions for (missing in 1, missing in 2, one step up, two steps up)."""

    table: Callable[[SparkSession, str], DataFrame]
    rows: Callable[[DataFrame, Column], DataFrame]
    missing_1: str
    missing_2: str
    step_1: str
    step_2: str
    # Columns of the table, kept by ``rows``, without nulls and equal where the keys are.
    by: tuple[str, ...] = BY_HASH


# Given, so that no job has to open files to find out.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(spark: SparkSession, sf_dir: str) -> int:
    """The size of the tables' files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet") for name in SCHEMAS]
    systems = [(path, path.getFileSystem(conf)) for path in paths]
    return sum(fs.getContentSummary(path).getLength() for path, fs in systems if fs.exists(path))


def _of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _customers(df: DataFrame, step: Column) -> DataFrame:
    return df.select(
        _text("c_custkey").alias("kdnr"),
        F.col("c_name").alias("kd_name"),
        (F.col("c_nationkey") + step).cast("decimal(5,2)").alias("rabatt_satz"),
    )


def _suppliers(df: DataFrame, step: Column) -> DataFrame:
    return df.select(
        _text("s_suppkey").alias("lief_nr"),
        (F.col("s_acctbal").cast("decimal(18,2)") + step).cast("decimal(18,2)").cast("string").alias("lief_kdnr"),
        F.col("s_name").alias("lief_name"),
        _text("s_nationkey").alias("ek_art_uebernahme"),
        F.when(F.col("s_nationkey") < 12, "J").otherwise("N").alias("ist_hauptlief"),
        F.lit(None).cast("string").alias("art_import_logik"),
    )


def _price(step: Column, kind: str = "decimal(18,2)") -> Column:
    return (F.col("p_retailprice").cast(kind) + step).cast(kind)


def _articles(df: DataFrame, step: Column) -> DataFrame:
    return df.select(
        F.col("p_partkey").alias("scs_pool_id"),
        _text("p_partkey").alias("art_nr"),
        F.lit(0).alias("idx"),
        F.col("p_name").alias("art_bez"),
        F.lit(1).cast("decimal(18,3)").alias("mengenfaktor"),
        _price(step).alias("vk_brutto"),
        F.when(F.col("p_size") > 40, 0).otherwise(1).alias("preiseinheit"),
        F.col("p_type").alias("kurzcode"),
        F.col("p_name").alias("bontext"),
        F.lit("Stk").alias("mengeneinheit"),
        F.lit(None).cast("string").alias("mengentyp"),
        F.lit(1).cast("decimal(18,3)").alias("gpfaktor"),
        F.col("p_brand").alias("wgr"),
        _text("p_size").alias("uwgr"),
        F.lit("J").alias("rabatt_kz"),
        F.lit("N").alias("preisgebunden_kz"),
        F.lit("N").alias("fsk_kz"),
        F.lit(None).cast("string").alias("notizen"),
    )


def _group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()


def _groups(df: DataFrame, step: Column) -> DataFrame:
    code = (F.col("p_size") + step) % 3
    return df.select(
        F.col("p_brand").alias("wgr"),
        _text("p_size").alias("uwgr"),
        F.concat_ws(" ", "p_brand", _text("p_size")).alias("wgr_bez"),
        F.when(code == 0, "4").when(code == 1, "9").otherwise("0").alias("mwst_kz"),
        F.when(F.col("p_size") < 25, "J").alias("rabatt_kz"),
        F.lit("N").alias("fsk_kz"),
    )


def _multi_ean(df: DataFrame, step: Column) -> DataFrame:
    return df.select(
        (F.col("p_partkey") * 10 + 1).cast("string").alias("ean_m"),
        (F.col("p_partkey") + step).cast("string").alias("ean_h"),
    ).dropDuplicates()


def _deposits(df: DataFrame, step: Column) -> DataFrame:
    return df.select(
        F.col("p_name").alias("pfand_bez"),
        _price(step).alias("pfand_brutto"),
        F.lit("J").alias("hinweispflicht"),
        F.col("p_brand").alias("wgr"),
        _text("p_size").alias("uwgr"),
        F.col("p_brand").alias("wgr_bez"),
        # Only small things carry a deposit; the rest has no article number here.
        F.when(F.col("p_type") == "SMALL", _text("p_partkey")).alias("art_nr"),
    )


def _press_articles(df: DataFrame, step: Column) -> DataFrame:
    code = F.col("p_size") % 4
    return df.select(
        _text("p_partkey").alias("art_nr"),
        F.col("p_name").alias("art_bez"),
        _price(step, "decimal(18,5)").alias("ek_netto"),
        _price(step).alias("vk_brutto"),
        F.when(code == 0, "9").when(code == 1, "4").when(code == 2, "0").otherwise("7").alias("mwst_kz"),
        F.lit("N").alias("fsk_kz"),
    )


# Numbers of part and supplier as texts, a missing one as it is hashed: equal where the keys are.
_SUPPLIER_ARTICLE = ("_teil", "_lieferant")


def _supplier_article_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    part, supplier = (F.coalesce(_text(c), F.lit(MISSING)).alias(k) for c, k in zip(("l_partkey", "l_suppkey"), _SUPPLIER_ARTICLE))
    return lines.groupBy(part, supplier).agg(
        F.min("l_extendedprice").alias("preis"), F.count_if(F.col("l_returnflag") == "R").alias("zurueck")
    )


def _supplier_articles(df: DataFrame, step: Column) -> DataFrame:
    part, supplier = (F.nullif(F.col(c), F.lit(MISSING)) for c in _SUPPLIER_ARTICLE)
    return df.select(
        *df.columns,
        F.concat_ws("-", part, supplier).alias("lief_art_nr"),
        part.alias("ean"),
        supplier.alias("lief_nr"),
        (F.col("preis").cast("decimal(18,5)") + step).cast("decimal(18,5)").alias("ek_netto"),
    )


_PART = ("p_type = 'LARGE'", "p_type = 'MEDIUM'", "p_type IN ('PROMO', 'SMALL')", "p_size > 30")

INPUTS = {
    "customers": Input(
        _of("customer"),
        _customers,
        "c_mktsegment = 'MACHINERY'",
        "c_mktsegment = 'HOUSEHOLD'",
        "c_mktsegment = 'FURNITURE'",
        "c_acctbal > 5000",
    ),
    "suppliers": Input(
        _of("supplier"),
        _suppliers,
        "s_nationkey < 3",
        "s_nationkey > 20",
        "s_acctbal > 3000",
        "s_nationkey BETWEEN 8 AND 12",
    ),
    "articles": Input(_of("part"), _articles, *_PART),
    "groups": Input(_group_table, _groups, "p_size > 45", "p_size < 5", "p_size > 25", "p_size BETWEEN 10 AND 30"),
    "multi_ean": Input(_of("part"), _multi_ean, *_PART),
    "deposits": Input(_of("part"), _deposits, "p_size > 45", "p_size < 5", "p_size > 25", "p_size BETWEEN 10 AND 30"),
    "press_articles": Input(_of("part"), _press_articles, *_PART),
    "supplier_articles": Input(
        _supplier_article_table,
        _supplier_articles,
        "zurueck > 1",
        "preis > 60000",
        "preis < 20000",
        "zurueck = 1",
        _SUPPLIER_ARTICLE,
    ),
}

# Query name -> (export, pair): the nine loads of the seven pairs.
LOADS = {
    "customers": ("customers", "kunden"),
    "suppliers": ("suppliers", "lieferanten"),
    "articles": ("articles", "artikel"),
    "groups": ("groups", "warengruppen"),
    "multi_ean": ("multi_ean", "mean"),
    "deposits": ("deposits", "pfand"),
    "supplier_articles": ("supplier_articles", "scs_liefart"),
    "press_articles": ("press_articles", "artikel"),
    "press_supplier_articles": ("press_articles", "scs_liefart"),
}


def pair_of(load: str):
    return PAIRS[LOADS[load][1]]


def staged(spark: SparkSession, sf_dir: str, load: str, day: date = DATES[0]) -> DataFrame:
    """The stage of the whole, unchanged table."""
    export, pair = LOADS[load]
    made = INPUTS[export]
    rows = made.rows(made.table(spark, sf_dir), F.lit(0))
    return staging.stage(rows, export, pair, day, load_time_of(day))


def key_of(load: str) -> tuple[str, ...]:
    """The columns by which the load's stages are joined (see ``vault.BY_HASH``)."""
    export, pair = LOADS[load]
    return INPUTS[export].by


def _versions(made: Input) -> list[tuple[Column, Column]]:
    """Which rows are in each of the three snapshots, and their price steps."""
    one = F.when(F.expr(made.step_1), 1).otherwise(0)
    two = F.when(F.expr(made.step_2), 2).otherwise(one)
    return [(~F.expr(made.missing_1), F.lit(0)), (~F.expr(made.missing_2), one), (F.lit(True), two)]


def _extra(made: Input) -> list[str]:
    return [name for name in made.by if name not in BY_HASH]


def snapshots(spark: SparkSession, sf_dir: str, load: str, days: tuple[date, ...] = DATES) -> list[DataFrame]:
    """The stages of the three snapshots."""
    export, pair = LOADS[load]
    made = INPUTS[export]
    base = made.table(spark, sf_dir)
    return [
        staging.stage(made.rows(base.filter(there), step), export, pair, day, load_time_of(day), _extra(made))
        for (there, step), day in zip(_versions(made), days)
    ]


def stacked(spark: SparkSession, sf_dir: str, load: str, days: tuple[date, ...] = DATES) -> DataFrame:
    """The stages of the three snapshots as one. Where rows have a key of their own, the table is read once."""
    export, pair = LOADS[load]
    made = INPUTS[export]
    if made.by == BY_HASH:
        return reduce(DataFrame.unionByName, snapshots(spark, sf_dir, load, days))
    base = made.table(spark, sf_dir)
    states = [
        F.when(there, F.struct(F.lit(day).alias("_tag"), load_time(load_time_of(day)).alias("_zeit"), step.alias("_stufe")))
        for (there, step), day in zip(_versions(made), days)
    ]
    rows = base.select("*", F.inline(F.array_compact(F.array(*states))))
    return staging.stage(made.rows(rows, F.col("_stufe")), export, pair, F.col("_tag"), F.col("_zeit"), made.by)


# --- till journal -----------------------------------------------------------------

ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


# The receipt's header is made once per order, the rest of a line once per line.
_HEADER = (
    "o_orderkey",
    "cast(o_custkey % 3 + 1 AS int) AS kasse_nr",
    "o_orderdate + make_dt_interval(0, cast(8 + o_custkey % 12 AS int)) AS bon_abschluss",
    "concat(o_custkey % 50, ' | Kasse') AS ma",
    "if(o_orderpriority = '1-URGENT', NULL, o_custkey) AS kdnr",
    "cast(o_totalprice AS decimal(18,2)) AS bon_summe",
    "o_orderstatus AS tse_info",
)
_LINE = (
    "bon_abschluss",
    "if(tse_info = 'F', NULL, bon_abschluss - INTERVAL '5' MINUTE) AS bon_beginn",
    "ma",
    "kdnr",
    "bon_summe",
    "CASE l_returnflag WHEN 'R' THEN 'RN | Position' WHEN 'N' THEN 'BV' ELSE 'BV | Position' END AS typ",
    "if(l_returnflag = 'R', '-', cast(l_partkey AS string)) AS art_nr",
    """CASE WHEN l_tax < 0.03D THEN 'EINZAHLUNG bar' WHEN l_tax < 0.05D THEN 'Auszahlung'
       ELSE concat('Artikel ', l_partkey) END AS art_bez""",
    "if(l_quantity <= 4, 'WGR fehlt', concat(l_suppkey, ':0 | Gruppe ', l_suppkey)) AS warengruppe",
    "cast(round(l_tax * 100) AS decimal(5,2)) AS mwst_satz",
    "cast(if(l_linestatus = 'F', NULL, 1) AS decimal(18,3)) AS mengenfaktor",
    "cast(l_quantity AS decimal(18,3)) AS menge",
    "cast(l_extendedprice AS decimal(18,2)) AS preis_einzel",
    "cast(if(l_quantity <= 4 AND l_discount = 0, 0D, l_extendedprice) AS decimal(18,2)) AS preis_gesamt",
    "cast(NULL AS string) AS infotext",
    "cast(NULL AS string) AS storno_ref",
    "tse_info",
)


def _lines_with_header(
    spark: SparkSession, sf_dir: str, hot_rows: int, period: tuple[date, date] | None = None
) -> DataFrame:
    lines = block_hot_groups(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey"],
        {"zeile": F.col("l_linenumber"), "artikel": F.shiftright("l_partkey", 6)},
        hot_rows,
    )
    orders = table(spark, sf_dir, "orders")
    if period:
        # A receipt is closed on the day of its order or the next: a bound that the scan can use, then the exact one.
        first, end = (F.lit(d).cast("timestamp_ntz") for d in (period[0] - timedelta(days=1), period[1]))
        orders = orders.filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < end))
    headers = orders.selectExpr(*_HEADER)
    if period:
        headers = headers.filter(F.to_date("bon_abschluss").between(period[0], period[1] - timedelta(days=1)))
    joined = lines.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumn("bon_nr", F.col("l_orderkey"))


def _as_journal_line(df: DataFrame) -> DataFrame:
    keys = [c for c in ("kasse_nr", "bon_nr", "pos", "hash", "hash_fuehrend") if c in df.columns]
    return df.selectExpr(*keys, *_LINE)


def journal(
    spark: SparkSession,
    sf_dir: str,
    load_ts: datetime = JOURNAL_TS,
    per_till: bool = False,
    hot_rows: int = HOT_ROWS,
    period: tuple[date, date] | None = None,
) -> DataFrame:
    """Numbered journal rows: one per lineitem row, with its order as the header.

    ``period`` (first day, day after the last) restricts them to receipts of these days.

    Numbering comes first, while rows are narrow; texts are made after the shuffle.
    """
    lines = _lines_with_header(spark, sf_dir, hot_rows, period)
    numbered = till.number_positions(lines, ORDER, (), F.col("_heiss"), per_till)
    return till.complete_lines(_as_journal_line(numbered), load_ts)


def journal_with_leading(
    spark: SparkSession, sf_dir: str, load_ts: datetime = JOURNAL_TS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``journal`` with ``hash_fuehrend``."""
    lines = _lines_with_header(spark, sf_dir, hot_rows)
    numbered = till.number_with_leading(lines, ORDER, F.col("l_returnflag") != "R", ())
    return till.complete_lines(_as_journal_line(numbered), load_ts)
