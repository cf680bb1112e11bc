"""The till journal: typed lines -> journal, receipts, positions, calendar.

Rows carry two helper columns until they are written: ``_datei`` (the file, the
scope of position numbers) and ``_block`` (see ``ordering``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillvault.functions import german, keys, lookups
from tillvault.functions.calendar import calendar_parts
from tillvault.operators.insert import insert_absent
from tillvault.operators.ordering import number_and_carry, number_in_order
from tillvault.schemas import CALENDAR, JOURNAL, POSITIONS, RECEIPTS
from tillvault.sources.stamp import load_time

SCOPE = "_datei"
HEADER = ("eintrag_ts", "bon_beginn", "bon_abschluss", "bon_summe", "kdnr", "tse_info", "storno_ref")


def _typed(df: DataFrame, columns: dict[str, str], extra: tuple[str, ...] = ()) -> DataFrame:
    return df.selectExpr(*(f"cast({n} AS {t}) AS {n}" for n, t in columns.items()), *extra)


def complete_lines(lines: DataFrame, load_ts: datetime | None) -> DataFrame:
    """Defaults and split columns of the journal lines; a projection."""
    return lines.withColumns(
        {
            "mengenfaktor": F.coalesce(F.col("mengenfaktor").cast("int"), F.lit(1)),
            "bon_beginn": F.coalesce("bon_beginn", "bon_abschluss"),
            "kdnr": F.coalesce(F.col("kdnr").cast("bigint").cast("string"), F.lit("0")),
            "bon_typ": F.trim(german.part(F.col("typ"), 0)),
            "pos_typ": F.trim(german.part(F.col("typ"), 1)),
            **({"eintrag_ts": load_time(load_ts)} if load_ts else {}),
        }
    )


def number_positions(
    lines: DataFrame,
    order: list[str],
    scope: tuple[str, ...] = (SCOPE,),
    crossing: Column | None = None,
    per_till: bool = False,
) -> DataFrame:
    """``pos`` and the journal key ``hash``.

    Positions are numbered per file and receipt number in the order of lines.
    Tills that share a receipt number are numbered through together, unless
    ``per_till`` asks for numbers without gaps.
    """
    group = [*scope, *(["kasse_nr"] if per_till else []), "bon_nr"]
    numbered = number_in_order(lines, group, order, "pos", crossing)
    return numbered.withColumn("hash", _position_hash())


def number_with_leading(
    lines: DataFrame, order: list[str], leads: Column, scope: tuple[str, ...] = (SCOPE,)
) -> DataFrame:
    """``number_positions`` plus ``hash_fuehrend``, the key of the leading position
    a line belongs to.

    The leading position is carried along (till, receipt, position) through the
    whole file, across receipts. The carry moves numbers; keys are made at the end.
    """
    numbered = number_and_carry(lines, scope, "kasse_nr", "bon_nr", order, leads, "pos", "_lead")
    return numbered.withColumns(
        {
            "hash": _position_hash(),
            "hash_fuehrend": keys.position_key(
                F.col("_lead.kasse_nr"), F.col("_lead.bon_nr"), F.col("_lead.pos")
            ),
        }
    ).drop("_lead")


def _position_hash() -> Column:
    return keys.position_key(F.col("kasse_nr"), F.col("bon_nr"), F.col("pos"))


def journal_rows(numbered: DataFrame) -> DataFrame:
    return _typed(numbered, JOURNAL)


# --- receipts ---------------------------------------------------------------------


def receipt_types(journal: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One row per receipt and type, with the rank of the type."""
    types = journal.select(*scope, "kasse_nr", "bon_nr", "bon_typ").distinct()
    return types.withColumn("rang", lookups.type_rank(F.col("bon_typ")))


def top_rank(types: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return types.groupBy(*scope, "kasse_nr", "bon_nr").agg(F.max("rang").alias("max_rang"))


def receipt_headers(journal: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Distinct header rows of the receipts."""
    return journal.select(*scope, "kasse_nr", "bon_nr", *HEADER).distinct()


def receipts(journal: DataFrame, scope: tuple[str, ...] = (), on_conflict: str = "raise") -> DataFrame:
    """One row per receipt; its type is the one of highest rank.

    A receipt with two types of that rank, or with differing headers, has no
    single row: the query fails and names it (``on_conflict='raise'``), or gives
    the row marked in ``widerspruch`` (``'flag'``).

    Lines are first counted by (receipt, type, header), which sums map-side and by
    hash, so neither a long receipt nor a hot one reaches a task as lines; what is
    decided per receipt is decided over one or two rows. The check is a filter, so
    it runs whatever columns are read.
    """
    if on_conflict not in ("raise", "flag"):
        raise ValueError("on_conflict must be 'raise' or 'flag'")
    bon = [*scope, "kasse_nr", "bon_nr"]
    kinds = journal.groupBy(*bon, "bon_typ", *HEADER).agg(F.count(F.lit(1)).alias("_n"))
    rank = lookups.type_rank(F.col("bon_typ"))
    header, typ = F.struct(*HEADER), F.struct(rank.alias("rang"), "bon_typ")
    strong = F.when(rank > 0, typ)
    one = kinds.groupBy(*bon).agg(
        F.min(header).alias("h"),
        F.max(header).alias("_h"),
        F.max(typ).alias("t"),
        F.min(strong).alias("_t1"),
        F.max(strong).alias("_t2"),
        # Its use below keeps the counting, and so the reduction, in the plan.
        F.sum("_n").alias("_n"),
    )
    conflict = ~F.col("h").eqNullSafe(F.col("_h")) | ~F.col("_t1").eqNullSafe(F.col("_t2"))
    extra = []
    if on_conflict == "raise":
        message = F.concat(
            F.lit("receipt with two types or headers: kasse_nr="),
            F.col("kasse_nr").cast("string"),
            F.lit(", bon_nr="),
            F.col("bon_nr").cast("string"),
        )
        one = one.filter(F.when(conflict, F.raise_error(message).cast("boolean")).otherwise(F.col("_n") > 0))
    else:
        one = one.filter("_n > 0")
        extra = [conflict.alias("widerspruch")]
    values = {
        "hash": keys.receipt_key(F.col("kasse_nr"), F.col("bon_nr")),
        **{n: F.col(f"h.{n}") for n in HEADER},
        "bon_typ": F.col("t.bon_typ"),
        "bon_datum": F.to_date(F.col("h.bon_abschluss")),
    }
    return one.select(
        *scope,
        *(values.get(n, F.col(n)).cast(t).alias(n) for n, t in RECEIPTS.items()),
        *extra,
    )


# --- positions --------------------------------------------------------------------


def leads(art_nr: Column) -> Column:
    return F.coalesce(art_nr, F.lit("")) != lookups.FOLLOWS


def with_group(journal: DataFrame) -> DataFrame:
    """Product group, its name and the cashier's number of each line; a projection."""
    wgr = F.trim(german.part(F.col("warengruppe"), 0))
    return journal.withColumns(
        {
            "wgr": lookups.position_group(wgr, F.col("warengruppe"), F.col("art_bez"), F.col("preis_gesamt")),
            "wgr_bez": F.trim(german.part(F.col("warengruppe"), 1)),
            "ma_id": F.trim(german.part(F.col("ma"), 0)),
            "hash_bon": keys.receipt_key(F.col("kasse_nr"), F.col("bon_nr")),
        }
    )


def positions(numbered: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Positions table from rows that have ``pos``, ``hash`` and ``hash_fuehrend``."""
    return _typed(with_group(numbered), POSITIONS, extra)


# --- calendar ---------------------------------------------------------------------


def calendar_days(receipt_rows: DataFrame) -> DataFrame:
    days = receipt_rows.select(F.col("bon_datum").alias("datum")).distinct()
    return _typed(days.withColumns(calendar_parts(F.col("datum"))), CALENDAR)


def load_calendar(calendar: DataFrame, receipt_rows: DataFrame) -> DataFrame:
    return insert_absent(calendar_days(receipt_rows), calendar, "datum")
