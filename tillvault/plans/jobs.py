"""Import jobs: export files -> tables of a store, one atomic load each."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillvault.functions.calendar import month_text
from tillvault.operators import journal as till
from tillvault.operators import staging, status, vault
from tillvault.operators.guards import check_keys, check_present, split_by_key
from tillvault.operators.insert import absent, first_of_key, likely, within
from tillvault.plans.session import tune
from tillvault.plans.store import MONTH, Load, Store
from tillvault.schemas import EXPORTS, FILES, JOURNAL, PAIRS, struct
from tillvault.sources.exports import FAULTS, FILE, LINE, read_export, split_lines

QUARANTINE = "quarantine"
LOADED, SET_ASIDE = "geladen", "zurueckgestellt"


def file_rows(
    spark: SparkSession, export: str | None, day: date | None, paths: Sequence[str], time: datetime, state: str = LOADED, reason: str | None = None
) -> DataFrame:
    """Rows of the table of files, which a load adds together with its data."""
    return spark.createDataFrame([(export, day, path, time, state, reason) for path in paths], struct(FILES))


def run_import(
    spark: SparkSession,
    store: Store,
    export: str,
    paths: str | Sequence[str],
    export_date: date,
    load_ts: datetime,
    on_bad_keys: str = "raise",
    close_scope: str = "open_version",
    files: DataFrame | None = None,
    on_bad_lines: str = "raise",
) -> dict[str, int]:
    """Loads the files of one export; all tables change together or not at all.

    Gives the number of rows staged, added and closed. Null or repeated keys
    stop the load, or are set aside in the staging area (``on_bad_keys='quarantine'``).
    ``files`` are added to the table of files (see ``streaming.filedrop``).

    A damaged line, or one with a field that is not of its kind, stops the load too.
    With ``on_bad_lines='set_aside'`` it goes, with its file and what is wrong, into the
    table of bad lines, is counted, and the others are loaded.
    """
    if on_bad_lines not in ("raise", "set_aside"):
        raise ValueError("on_bad_lines must be 'raise' or 'set_aside'")
    if on_bad_keys not in ("raise", QUARANTINE):
        raise ValueError(f"on_bad_keys must be 'raise' or {QUARANTINE!r}")
    if export == "journal" and on_bad_keys == QUARANTINE:
        raise ValueError("the journal has no quarantine: lines without a key stop its load")
    tune(spark)
    load = store.begin()
    try:
        if export == "journal":
            counts = _load_journal(spark, load, paths, export_date, load_ts, on_bad_lines)
        else:
            counts = _load_master(
                spark, load, export, paths, export_date, load_ts, on_bad_keys, close_scope, on_bad_lines
            )
        if files is not None:
            load.append("dateien_t", files)
        load.commit()
    finally:
        load.close()
    return counts


def _good_lines(
    spark: SparkSession, load: Load, export: str, paths: str | Sequence[str], day: date, on_bad_lines: str, needed: Sequence[str] = (), **options
) -> tuple[DataFrame, dict[str, int]]:
    """The lines to load. Bad ones, also those without a value that is needed, go to their table; the files are read once."""
    if on_bad_lines == "raise":
        return read_export(spark, export, paths, **options), {}
    lines = read_export(spark, export, paths, strict=False, **options)
    empty = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in needed), F.lit(None).cast("string")))
    lines = load.stage(f"{export}_gelesen", lines.withColumn(FAULTS, F.array_union(FAULTS, empty)))
    good, bad = split_lines(lines, export)
    bad = bad.select(
        F.lit(export).alias("export"), F.lit(day).alias("export_datum"), F.col(FILE).alias("pfad"),
        F.col(LINE).alias("zeile"), F.array_join(FAULTS, ",").alias("fehler"),
    )
    load.append("schlechte_zeilen_t", bad)
    return good, {f"{export}.bad_lines": load.rows["schlechte_zeilen_t"]}


# --- master data ------------------------------------------------------------------


def _load_master(
    spark: SparkSession,
    load: Load,
    export: str,
    paths: str | Sequence[str],
    export_date: date,
    load_ts: datetime,
    on_bad_keys: str,
    close_scope: str,
    on_bad_lines: str,
) -> dict[str, int]:
    rows, counts = _good_lines(spark, load, export, paths, export_date, on_bad_lines)
    # All stages are checked before any table is written.
    stages = {}
    for target in EXPORTS[export].targets:
        stage = load.stage(target.pair, staging.stage(rows, export, target.pair, export_date, load_ts))
        # A missing part of a composite key is text in its hash: the parts are looked at too.
        keys = ("hash", *PAIRS[target.pair].keys)
        if on_bad_keys == QUARANTINE:
            good, bad = split_by_key(stage, keys)
            load.stage(f"{target.pair}_{QUARANTINE}", bad)
            counts[f"{target.pair}.quarantine"] = load.rows[f"{target.pair}_{QUARANTINE}"]
            stage = load.stage(f"{target.pair}_good", good)
            load.rows[target.pair] = load.rows[f"{target.pair}_good"]
        else:
            check_keys(stage, keys, what=target.pair)
        stages[target.pair] = stage

    for name, stage in stages.items():
        pair = PAIRS[name]
        counts[f"{name}.stage"] = load.rows[name]
        # Only the buckets of the stage's keys are read and rewritten, and only the stage is shuffled.
        buckets = load.touched(stage, pair.hub, pair.sat)
        hub = vault.load_hub(load.in_buckets(pair.hub, buckets), stage, pair, unseen="neu")
        counts[f"{name}.hub_new"] = load.replace_buckets(pair.hub, hub, buckets, F.count_if("neu"))
        closed = ~F.col("gueltig")
        if close_scope == "open_version":
            # Closed versions never change: only the open ones are read and rewritten.
            sat = vault.load_sat(load.in_buckets(pair.sat, buckets), stage, pair)
        else:
            sat = vault.load_sat(load.current(pair.sat), stage, pair, close_scope)
            closed &= F.col("eintrag_ets") == F.lit(load_ts.isoformat(sep=" ")).cast("timestamp_ntz")
            buckets = load.rewrite(pair.sat)
        counts[f"{name}.sat_closed"] = load.replace_buckets(pair.sat, sat, buckets, F.count_if(closed))
    return counts


# --- till journal -----------------------------------------------------------------


def _load_journal(
    spark: SparkSession, load: Load, paths: str | Sequence[str], export_date: date, load_ts: datetime, on_bad_lines: str
) -> dict[str, int]:
    # The lines with their place in the file are written first: places are only
    # meaningful within one reading of the files.
    needed = ["kasse_nr", "bon_nr", "bon_abschluss"]
    good, counts = _good_lines(spark, load, "journal", paths, export_date, on_bad_lines, needed, file_order=True)
    raw = good if counts else load.stage("journal_lines", good)
    check_present(raw, needed, "journal")
    lines = till.complete_lines(raw, load_ts)
    numbered = till.number_with_leading(lines, ["_zeile"], till.leads(F.col("art_nr")))

    # Files of one batch count as loaded one after the other, by name: of rows
    # with the same key the first file's stays. Insert-if-absent and this choice
    # use the same key, so they share one shuffle. Journal and positions have the
    # same keys and are always loaded together: one anti-join serves both.
    # Of the existing rows only those of receipts that the new files may have are shuffled:
    # by the range of numbers, which skips row groups, and by a filter of the receipts.
    place = ["kasse_nr", "bon_nr", "pos"]
    bon = place[:2]
    own = raw.select(*bon).distinct()

    def known_of(table: str) -> DataFrame:
        return likely(within(load.current(table), raw, "bon_nr"), own, bon)

    known = known_of("kassenjournal_t")
    fresh = first_of_key(absent(numbered, known, place), place, [till.SCOPE])
    fresh = by_month(fresh.select(*JOURNAL, "hash_fuehrend"), "bon_abschluss")
    fresh = load.stage("journal", fresh.sortWithinPartitions("bon_nr", "pos"))

    # Receipts come from all lines of their file, also from those known already.
    of_file = till.receipts(lines, scope=(till.SCOPE,))
    receipts = first_of_key(absent(of_file, known_of("kassenbons_t"), bon), bon, [till.SCOPE]).drop(till.SCOPE)

    load.append("kassenjournal_t", fresh.select(*JOURNAL, MONTH))
    load.append("kassenbons_pos_t", till.positions(fresh, extra=(MONTH,)))
    receipts = load.append("kassenbons_t", by_month(receipts, "bon_datum").sortWithinPartitions("bon_nr"))
    days = absent(till.calendar_days(receipts), load.current("kalender_t"), "datum")
    load.append("kalender_t", days)
    lines_read = load.rows["journal_lines"] if not counts else load.rows["journal_gelesen"] - counts["journal.bad_lines"]
    return counts | {
        "journal.stage": lines_read,
        "journal.new": load.rows["kassenjournal_t"],
        "receipts.new": load.rows["kassenbons_t"],
        "calendar.new": load.rows["kalender_t"],
    }


def by_month(df: DataFrame, day: str) -> DataFrame:
    """Adds the month and groups rows by it, in partitions of even size.

    A month that holds much of the data is split by adaptive execution, small
    months are put together. So a load of many months writes few files, each of
    one month; sorted by receipt number, they are skipped by their statistics.
    """
    return df.withColumn(MONTH, month_text(F.col(day))).hint("rebalance", F.col(MONTH))


# --- status -----------------------------------------------------------------------


def loaded_months(store: Store) -> list[str]:
    """The months that have receipts."""
    return [row[0] for row in store.months("kassenbons_t").collect()]


def last_change(store: Store) -> datetime | None:
    return status.last_change(store.read("kassenbons_t")).first()[0]


def last_file(store: Store, export: str) -> date | None:
    """Date of the newest export of a kind.

    Kinds that share a hub (articles, press articles; supplier articles) are told
    apart by the source their keys were first seen in.
    """
    spec = EXPORTS[export]
    pair = PAIRS[spec.targets[0].pair]
    shared = pair.name in ("artikel", "scs_liefart")
    return status.last_file(store.read(pair.hub), spec.quelle if shared else None).first()[0]
