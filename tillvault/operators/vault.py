"""Hub and satellite loads: pure functions (state, stage) -> next state.

Parquet tables know no UPDATE, so a load is written as the join that yields the
whole next state. One equi-join on the key hash per table does insert, touch,
close and re-open in a single pass. Keys are unique on the stage (checked) and
in the hub, and a satellite has one open row per key, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillvault.schemas import OPEN_DATE, OPEN_TS, Pair, hub_columns, sat_columns, struct

CLOSE_SCOPES = ("open_version", "all_versions")
# In bulk, exports count as loaded by date; those of one date by load time, then source.
LOAD_ORDER = ("export_datum", "eintrag_ts", "quelle")


def open_ts() -> Column:
    return F.lit(OPEN_TS).cast("timestamp_ntz")


def open_date() -> Column:
    return F.lit(OPEN_DATE).cast("date")


def empty_hub(spark: SparkSession, pair: Pair) -> DataFrame:
    return spark.createDataFrame([], struct(hub_columns(pair)))


def empty_sat(spark: SparkSession, pair: Pair) -> DataFrame:
    return spark.createDataFrame([], struct(sat_columns(pair)))


# Operators that take ``by`` work by these columns instead of the hash, and keep them: columns
# without nulls that are equal exactly where hashes are. Rows that lie by them already, as
# after an aggregation, then stay where they are, and hashes are not shuffled.
BY_HASH = ("hash",)


def _kept(by: Sequence[str]) -> list[str]:
    return [name for name in by if name != "hash"]


# --- hub --------------------------------------------------------------------------


def _hub_rows(stage: DataFrame, pair: Pair) -> DataFrame:
    return stage.select(
        "hash",
        F.col("eintrag_ts").alias("eintrag_ats"),
        F.col("export_datum").alias("gueltig_adtm"),
        F.col("export_datum").alias("zuletzt_gesehen"),
        "quelle",
        *pair.keys,
    )


def first_hub(stage: DataFrame, pair: Pair) -> DataFrame:
    """The hub after the very first load."""
    return _hub_rows(stage, pair)


def load_hub(
    hub: DataFrame, stage: DataFrame, pair: Pair, touch: bool = True, unseen: str | None = None
) -> DataFrame:
    """Adds unseen keys; with ``touch`` also moves ``zuletzt_gesehen`` of the known ones.

    The last load wins even if its export is the older one. Keys missing from
    the stage stay as they are. ``unseen`` names a column that marks the keys added.
    """
    h, s = hub.alias("h"), _hub_rows(stage, pair).alias("s")
    newest = ("zuletzt_gesehen",) if touch else ()
    columns = (
        f"coalesce(s.{n}, h.{n}) AS {n}" if n in newest else f"coalesce(h.{n}, s.{n}) AS {n}"
        for n in hub_columns(pair)
    )
    if unseen:
        columns = (*columns, f"h.hash IS NULL AS {unseen}")
    return h.join(s, F.col("h.hash") == F.col("s.hash"), "full_outer").selectExpr(*columns)


def bulk_hub(stages: DataFrame, pair: Pair, by: Sequence[str] = BY_HASH) -> DataFrame:
    """The hub from all stages stacked, in the order of their loads (see ``LOAD_ORDER``)."""
    kept = _kept(by)
    row = ["eintrag_ts", "export_datum", "quelle", *pair.keys, *(["hash"] if kept else [])]
    first = F.min_by(F.struct(*row), F.struct(*LOAD_ORDER))
    seen = stages.groupBy(*by).agg(first.alias("f"), F.max("export_datum").alias("zuletzt_gesehen"))
    return seen.select(
        F.col("f.hash" if kept else "hash").alias("hash"),
        F.col("f.eintrag_ts").alias("eintrag_ats"),
        F.col("f.export_datum").alias("gueltig_adtm"),
        "zuletzt_gesehen",
        F.col("f.quelle").alias("quelle"),
        *(F.col(f"f.{k}").alias(k) for k in pair.keys),
        *kept,
    )


# --- satellite --------------------------------------------------------------------


def _sat_rows(stage: DataFrame, pair: Pair, kept: Sequence[str] = ()) -> DataFrame:
    return stage.select(
        "hash",
        "hash_diff",
        F.col("eintrag_ts").alias("eintrag_ats"),
        open_ts().alias("eintrag_ets"),
        F.col("export_datum").alias("gueltig_adtm"),
        open_date().alias("gueltig_edtm"),
        F.lit(True).alias("gueltig"),
        "quelle",
        *pair.attributes,
        *kept,
    )


def first_sat(stage: DataFrame, pair: Pair, by: Sequence[str] = BY_HASH) -> DataFrame:
    """The satellite after the very first load."""
    return _sat_rows(stage, pair, _kept(by))


def changed(new_diff: Column, old_diff: Column) -> Column:
    return new_diff != old_diff


def load_sat(
    sat: DataFrame, stage: DataFrame, pair: Pair, close_scope: str = "open_version", by: Sequence[str] = BY_HASH
) -> DataFrame:
    """Closes changed versions and opens new ones.

    ``close_scope='all_versions'`` also moves the end dates of versions closed
    earlier, for every key that changes in this load.
    """
    if close_scope not in CLOSE_SCOPES:
        raise ValueError(f"close_scope must be one of {CLOSE_SCOPES}")
    v, s = sat.alias("v"), _sat_rows(stage, pair, _kept(by)).alias("s")
    names = [*sat_columns(pair), *_kept(by)]
    # Only open versions meet a staged row; closed ones pass through the outer side.
    meets = F.col("v.gueltig")
    for name in by:
        meets = meets & (F.col(f"v.{name}") == F.col(f"s.{name}"))
    joined = v.join(s, meets, "full_outer").withColumn(
        "_zu", F.coalesce(changed(F.col("s.hash_diff"), F.col("v.hash_diff")), F.lit(False))
    )
    ends = {"eintrag_ets": "s.eintrag_ats", "gueltig_edtm": "s.gueltig_adtm", "gueltig": "false"}
    fields = (f"if(_zu, {ends[n]}, v.{n}) AS {n}" if n in ends else f"v.{n}" for n in names)
    old = F.expr(f"struct({', '.join(fields)}, _zu)")
    new = F.expr(f"struct({', '.join(f's.{n}' for n in names)}, false AS _zu)")
    rows = joined.select(
        F.when(F.col("_zu"), F.array(old, new))
        .when(F.col("v.hash").isNotNull(), F.array(old))
        .otherwise(F.array(new))
        .alias("zeilen")
    ).select(F.inline("zeilen"))
    if close_scope == "all_versions":
        rows = _move_all_ends(rows)
    return rows.select(*names)


def _move_all_ends(rows: DataFrame) -> DataFrame:
    # A key has one version per export, so the window is small.
    mine = Window.partitionBy("hash")
    moved = ~F.col("gueltig") & F.max("_zu").over(mine)
    end = {n: F.max(F.when(F.col("_zu"), F.col(n))).over(mine) for n in ("eintrag_ets", "gueltig_edtm")}
    return rows.withColumns({n: F.when(moved, c).otherwise(F.col(n)) for n, c in end.items()})


def replay(
    stages: Sequence[DataFrame], pair: Pair, close_scope: str = "open_version", by: Sequence[str] = BY_HASH
) -> tuple[DataFrame, DataFrame]:
    """Hub and satellite after loading the stages one after the other."""
    first, *rest = stages
    hub = reduce(lambda state, s: load_hub(state, s, pair), rest, first_hub(first, pair))
    sat = reduce(lambda state, s: load_sat(state, s, pair, close_scope, by), rest, first_sat(first, pair, by))
    return hub, sat


def bulk_sat(stages: DataFrame, pair: Pair, by: Sequence[str] = BY_HASH) -> DataFrame:
    """The whole history from all stages stacked: the backfill form of ``load_sat``.

    One shuffle on the key whatever the number of exports; equal to loading them
    one by one in ``LOAD_ORDER``.
    """
    in_time = Window.partitionBy(*by).orderBy(*LOAD_ORDER)
    before = F.lag("hash_diff").over(in_time)
    versions = (
        stages.withColumn("_vorher", before)
        .filter(F.col("_vorher").isNull() | changed(F.col("hash_diff"), F.col("_vorher")))
        .withColumns(
            {
                "_naechster_ts": F.lead("eintrag_ts").over(in_time),
                "_naechstes_datum": F.lead("export_datum").over(in_time),
            }
        )
    )
    return versions.select(
        "hash",
        "hash_diff",
        F.col("eintrag_ts").alias("eintrag_ats"),
        F.coalesce("_naechster_ts", open_ts()).alias("eintrag_ets"),
        F.col("export_datum").alias("gueltig_adtm"),
        F.coalesce("_naechstes_datum", open_date()).alias("gueltig_edtm"),
        F.col("_naechstes_datum").isNull().alias("gueltig"),
        "quelle",
        *pair.attributes,
        *_kept(by),
    )
