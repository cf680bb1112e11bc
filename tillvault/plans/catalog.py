"""The query catalogue over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillvault.operators import guards, insert, reports, status, vault, views
from tillvault.operators import journal as till
from tillvault.plans import frames, texts
from tillvault.plans.session import tune
from tillvault.schemas import EXPORTS, hub_columns, sat_columns
from tillvault.sources.exports import FAULTS, split_lines, typed

Query = Callable[[SparkSession, str], DataFrame]

SPLIT_DAY = date(1998, 7, 1)
AS_OF_DAY = date(2023, 3, 15)
ORDER_UNTIL = date(1999, 3, 1)
ORDER_WEEKS = 4
BAKERY = "s_nationkey % 2 = 0"  # the suppliers whose groups are bakery
MEAT = "s_nationkey % 2 = 1"
# What the hashes of receipts and positions are made of. An order without a customer has no till.
RECEIPT_KEY, TILL = ("kasse_nr", "bon_nr"), ("kasse_nr",)
POSITION_KEY = (*RECEIPT_KEY, "pos")


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- master data ------------------------------------------------------------------


def stage(load: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.staged(spark, sf_dir, load)


def hub_load(load: str, spark: SparkSession, sf_dir: str, touch: bool = False) -> DataFrame:
    pair = frames.pair_of(load)
    first, *rest = frames.snapshots(spark, sf_dir, load)
    return reduce(lambda hub, s: vault.load_hub(hub, s, pair, touch), rest, vault.first_hub(first, pair))


def sat_history(load: str, spark: SparkSession, sf_dir: str, close_scope: str = "open_version") -> DataFrame:
    pair = frames.pair_of(load)
    sat = vault.replay(frames.snapshots(spark, sf_dir, load), pair, close_scope, frames.key_of(load))[1]
    return sat.select(*sat_columns(pair))


def sat_bulk(load: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = frames.pair_of(load)
    return vault.bulk_sat(frames.stacked(spark, sf_dir, load), pair, frames.key_of(load)).select(*sat_columns(pair))


def hub_bulk(load: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = frames.pair_of(load)
    return vault.bulk_hub(frames.stacked(spark, sf_dir, load), pair, frames.key_of(load)).select(*hub_columns(pair))


def sat_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same export loaded twice: the second load changes nothing."""
    once = frames.staged(spark, sf_dir, "articles")
    return vault.replay([once, once], frames.pair_of("articles"))[1]


def sat_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and press articles feed one satellite with different change hashes."""
    articles = frames.staged(spark, sf_dir, "articles", frames.DATES[0])
    press = frames.staged(spark, sf_dir, "press_articles", frames.DATES[1])
    return vault.replay([articles, press], frames.pair_of("articles"))[1]


def hub_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and press articles of one date, stacked against their order: articles come first."""
    stages = [frames.staged(spark, sf_dir, load) for load in ("press_articles", "articles")]
    return vault.bulk_hub(stacked(stages), frames.pair_of("articles"))


def parse_export(export: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's texts, as typed by its reader."""
    return typed(texts.export_texts(spark, sf_dir, export), export)


# The field that names a line of an export.
NAMED_BY = {"articles": "Strichcode", "customers": "KDNR", "journal": "Kassen-Nr."}


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of three exports that are set aside, and the columns that are not of their kind."""

    def bad(export: str) -> DataFrame:
        raw = texts.faulty_texts(spark, sf_dir, export)
        lines = typed(raw, export, extra=[F.col(f"`{NAMED_BY[export]}`").alias("schluessel")], strict=False)
        found = F.array_join(FAULTS, ",").alias("fehler")
        return split_lines(lines, export)[1].select(F.lit(export).alias("export"), "schluessel", found)

    return stacked([bad(export) for export in texts.FAULTY])


def parse_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of which no line is set aside, typed as ever."""
    lines = typed(texts.faulty_texts(spark, sf_dir, "articles"), "articles", strict=False)
    return split_lines(lines, "articles")[0]


def _vault(spark: SparkSession, sf_dir: str, load: str, days=frames.DATES) -> tuple[DataFrame, DataFrame]:
    """Hub and satellite of a load, by the bulk form."""
    pair, by = frames.pair_of(load), frames.key_of(load)
    stages = frames.stacked(spark, sf_dir, load, days)
    return vault.bulk_hub(stages, pair, by), vault.bulk_sat(stages, pair, by)


def _current(spark: SparkSession, sf_dir: str, load: str) -> DataFrame:
    return views.current(*_vault(spark, sf_dir, load), frames.pair_of(load), frames.key_of(load))


def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir, "customers")


def asof_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.as_of(*_vault(spark, sf_dir, "articles"), frames.pair_of("articles"), AS_OF_DAY)


# --- till journal -----------------------------------------------------------------


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till.journal_rows(frames.journal(spark, sf_dir))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till.receipts(_journal(spark, sf_dir))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till.positions(frames.journal_with_leading(spark, sf_dir))


def _before_split(column: str):
    return F.to_date(column) < F.lit(SPLIT_DAY)


def journal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir)


def journal_per_till(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till.journal_rows(frames.journal(spark, sf_dir, per_till=True)).select("hash", "kasse_nr", "bon_nr", "pos")


def journal_anti_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early receipts are loaded; a later file brings everything: only the rest is added."""
    old = _journal(spark, sf_dir).filter(_before_split("bon_abschluss"))
    new = till.journal_rows(frames.journal(spark, sf_dir, frames.RELOAD_TS))
    return insert.insert_absent(new, old, POSITION_KEY, TILL)


def journal_filtered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The early receipts are loaded; a later file brings some of them again, of numbers all over the range.

    The rows it adds, by number of receipt and position. Of those loaded only what the
    file's receipts mark is compared.
    """
    old = _journal(spark, sf_dir).filter(_before_split("bon_abschluss"))
    lines = frames.table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit(SPLIT_DAY))
    own = lines.select(F.col("l_orderkey").alias("bon_nr")).distinct()
    new = till.journal_rows(frames.journal(spark, sf_dir, frames.RELOAD_TS)).join(own, "bon_nr", "left_semi")
    return insert.absent(new, insert.likely(old, own, ["bon_nr"]), ["kasse_nr", "bon_nr", "pos"])


def receipt_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = till.receipt_types(_journal(spark, sf_dir))
    top = till.top_rank(types).withColumnRenamed("max_rang", "rang")
    return types.join(top, ["kasse_nr", "bon_nr", "rang"]).select("kasse_nr", "bon_nr", "bon_typ", "rang")


def receipt_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till.receipt_headers(_journal(spark, sf_dir))


def receipts_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _receipts(spark, sf_dir).filter(F.col("bon_datum") < F.lit(SPLIT_DAY))
    new = till.receipts(till.journal_rows(frames.journal(spark, sf_dir, frames.RELOAD_TS)))
    return insert.insert_absent(new, old, RECEIPT_KEY, TILL)


def positions_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = till.with_group(frames.journal(spark, sf_dir))
    return rows.select("hash", "hash_bon", "wgr", "wgr_bez", "ma_id", "preis_gesamt")


def leading_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).select("hash", "kasse_nr", "bon_nr", "pos", "art_nr", "hash_fuehrend")


def positions_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = till.positions(frames.journal_with_leading(spark, sf_dir).filter(_before_split("bon_abschluss")))
    new = till.positions(frames.journal_with_leading(spark, sf_dir, frames.RELOAD_TS))
    return insert.insert_absent(new, old, POSITION_KEY, TILL)


def _receipt_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir).select("bon_datum")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return till.calendar_days(_receipt_days(spark, sf_dir))


def calendar_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _receipt_days(spark, sf_dir)
    old = till.calendar_days(days.filter(F.col("bon_datum") < F.lit(SPLIT_DAY)))
    return till.load_calendar(old, days)


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose (order, line number) is not unique."""
    return guards.bad_keys(frames.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- status -----------------------------------------------------------------------


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.loaded_months(_receipts(spark, sf_dir))


def last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of receipts that came with two loads."""
    return status.last_change(receipts_load(spark, sf_dir))


def last_file_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.last_file(_vault(spark, sf_dir, "customers")[0])


def last_file_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles are loaded first, press articles last: each key keeps its first source."""
    articles = frames.snapshots(spark, sf_dir, "articles")[0]
    press = frames.snapshots(spark, sf_dir, "press_articles")[2]
    pair = frames.pair_of("articles")
    hub = vault.load_hub(vault.first_hub(articles, pair), press, pair)
    return status.last_file(hub, EXPORTS["press_articles"].quelle)


# --- views and reports ------------------------------------------------------------


def asof_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = frames.pair_of("articles")
    articles = views.history(*_vault(spark, sf_dir, "articles", frames.SALE_DATES), pair)
    rows = till.with_group(frames.journal(spark, sf_dir))
    days = _receipts(spark, sf_dir)
    return views.sold_as(rows, days, articles, ["vk_brutto", "wgr"])


def ean_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per main barcode; article numbers ending in 1 are additional barcodes."""
    mean = _current(spark, sf_dir, "multi_ean")
    sold = frames.journal(spark, sf_dir).select("art_nr", "menge")
    # Summed per sold barcode first: one row per article meets the barcode table.
    per_code = sold.groupBy("art_nr").agg(F.sum("menge").alias("menge"))
    resolved = views.main_ean(per_code, mean)
    return resolved.groupBy("art_nr").agg(F.sum("menge").cast("decimal(18,3)").alias("menge"))


def voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt that consists of ``RN`` lines only voids the one numbered before it."""
    marked = _receipts(spark, sf_dir).withColumn(
        "storno_ref", F.when(F.col("bon_typ") == "RN", (F.col("bon_nr") - 1).cast("string"))
    )
    return views.voids(marked)


def voids_without_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``voids``, but the receipts of one till write their reference as text."""
    number = (F.col("bon_nr") - 1).cast("string")
    ref = F.when(F.col("kasse_nr") == 2, F.concat(F.lit("Bon "), number)).otherwise(number)
    marked = _receipts(spark, sf_dir).withColumn("storno_ref", F.when(F.col("bon_typ") == "RN", ref))
    return views.voids_without_receipt(marked)


def order_aid(suppliers: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of some suppliers. Only the period's orders and their lines are read on."""
    period = (ORDER_UNTIL - timedelta(weeks=ORDER_WEEKS), ORDER_UNTIL)
    rows = frames.journal(spark, sf_dir, period=period)
    groups = frames.table(spark, sf_dir, "supplier").filter(suppliers)
    groups = groups.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(":0")).alias("wgr"))
    receipts = till.receipts(till.journal_rows(rows))
    return reports.order_aid(till.with_group(rows), receipts, groups, ORDER_UNTIL, ORDER_WEEKS)


def order_aid_open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bakery groups. The shop is taken as closed on days whose number can be divided by five, and on Mondays."""
    period = (ORDER_UNTIL - timedelta(weeks=ORDER_WEEKS), ORDER_UNTIL)
    rows = frames.journal(spark, sf_dir, period=period)
    closed = (F.dayofmonth("bon_datum") % 5 == 0) | (F.weekday("bon_datum") == 0)
    receipts = till.receipts(till.journal_rows(rows)).filter(~closed)
    groups = frames.table(spark, sf_dir, "supplier").filter(BAKERY)
    groups = groups.select(F.concat(F.col("s_suppkey").cast("string"), F.lit(":0")).alias("wgr"))
    days = till.calendar_days(receipts)
    return reports.order_aid_open(till.with_group(rows), receipts, days, groups, ORDER_UNTIL, ORDER_WEEKS)


def inventory_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = partial(_current, spark, sf_dir)
    return reports.inventory_articles(current("articles"), current("groups"), current("deposits"))


def inventory_supplier_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = partial(_current, spark, sf_dir)
    return reports.inventory_supplier_articles(current("supplier_articles"), current("suppliers"), current("articles"))


def card_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.transaction_mix(_journal(spark, sf_dir))


def visits_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visits_by_hour(_receipts(spark, sf_dir))


def visits_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visits_by_customer(_receipts(spark, sf_dir))


def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal -> receipts and positions -> totals per month."""
    rows = till.with_group(frames.journal(spark, sf_dir))
    return reports.month_totals(_receipts(spark, sf_dir), rows)


def _tuned(query: Query) -> Query:
    return lambda spark, sf_dir: query(tune(spark, frames.input_bytes(spark, sf_dir)), sf_dir)


def catalog() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for load in frames.LOADS:
        found[f"stage_{load}"] = partial(stage, load)
        found[f"hub_load_{load}"] = partial(hub_load, load)
        found[f"hub_touch_{load}"] = partial(hub_load, load, touch=True)
        found[f"hub_bulk_{load}"] = partial(hub_bulk, load)
        found[f"sat_history_{load}"] = partial(sat_history, load)
        found[f"sat_bulk_{load}"] = partial(sat_bulk, load)
    for export in texts.TEXTS:
        found[f"parse_{export}"] = partial(parse_export, export)
    found |= {
        "sat_idempotent": sat_idempotent,
        "sat_close_all_versions": partial(sat_history, "articles", close_scope="all_versions"),
        "sat_two_sources": sat_two_sources,
        "hub_two_sources": hub_two_sources,
        "journal_positions": journal_positions,
        "journal_per_till": journal_per_till,
        "journal_anti_load": journal_anti_load,
        "journal_filtered_load": journal_filtered_load,
        "receipt_type": receipt_type,
        "receipt_headers": receipt_headers,
        "receipts": _receipts,
        "receipts_load": receipts_load,
        "positions": _positions,
        "positions_groups": positions_groups,
        "positions_load": positions_load,
        "leading_position": leading_position,
        "calendar": calendar,
        "calendar_load": calendar_load,
        "key_violations": key_violations,
        "months": months,
        "last_change": last_change,
        "last_file_plain": last_file_plain,
        "last_file_by_source": last_file_by_source,
        "current_view": current_view,
        "asof_view": asof_view,
        "asof_sale": asof_sale,
        "ean_resolve": ean_resolve,
        "voids": voids,
        "voids_without_receipt": voids_without_receipt,
        "parse_rejects": parse_rejects,
        "parse_accepted": parse_accepted,
        "order_aid_bakery": partial(order_aid, BAKERY),
        "order_aid_meat": partial(order_aid, MEAT),
        "order_aid_open_days": order_aid_open_days,
        "inventory_articles": inventory_articles,
        "inventory_supplier_articles": inventory_supplier_articles,
        "card_mix": card_mix,
        "visits_by_hour": visits_by_hour,
        "visits_by_customer": visits_by_customer,
        "month_totals": month_totals,
    }
    return {name: _tuned(query) for name, query in found.items()}
