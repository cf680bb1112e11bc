"""The catalogue's queries as plain SQL over the same tables, for comparison.

Written from the definitions, not from the DataFrame code: histories come from
lag/lead over stacked snapshots, the carry from one global window.
"""

from __future__ import annotations

from datetime import date

from tillvault.plans import catalog, frames
from tillvault.schemas import RECEIPTS as RECEIPT_COLUMNS
from tillvault.schemas import EXPORTS, JOURNAL, PAIRS, POSITIONS, stage_columns


def text(expr: str) -> str:
    return f"coalesce(trim(cast({expr} AS VARCHAR)), 'nan')"


def hashed(names) -> str:
    return "md5(" + " || ':' || ".join(text(n) for n in names) + ")"


def typed(kind: str) -> str:
    return {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}.get(kind, kind.upper())


# --- export rows ------------------------------------------------------------------

SOURCES = {
    "groups": "(SELECT DISTINCT p_brand, p_size FROM part)",
    "supplier_articles": """(SELECT l_partkey, l_suppkey, min(l_extendedprice) AS preis,
        count(*) FILTER (WHERE l_returnflag = 'R') AS zurueck FROM lineitem GROUP BY ALL)""",
    "customers": "customer",
    "suppliers": "supplier",
}

_ARTICLE_GROUP = "p_brand || ':' || p_size"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) + {step} AS DECIMAL(18,2))"
_PRESS_GROUP = "CASE p_size % 4 WHEN 0 THEN '9999:0' WHEN 1 THEN '9998:0' WHEN 2 THEN '9997:0' ELSE '' END"
_VAT = "CASE (p_size + {step}) % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"

ROWS = {
    "customers": {
        "kdnr": "c_custkey",
        "kd_name": "c_name",
        "rabatt_satz": "c_nationkey + {step}",
    },
    "suppliers": {
        "lief_nr": "s_suppkey",
        "lief_kdnr": "CAST(CAST(s_acctbal AS DECIMAL(18,2)) + {step} AS DECIMAL(18,2))",
        "lief_name": "s_name",
        "ek_art_uebernahme": "s_nationkey",
        "ist_hauptlief": "CASE WHEN s_nationkey < 12 THEN 'J' ELSE 'N' END",
        "art_import_logik": "NULL",
    },
    "articles": {
        "art_nr": "p_partkey",
        "idx": "0",
        "scs_pool_id": "p_partkey",
        "art_bez": "p_name",
        "mengenfaktor": "1",
        "vk_brutto": _PRICE,
        "preiseinheit": "CASE WHEN p_size > 40 THEN 0 ELSE 1 END",
        "kurzcode": "p_type",
        "bontext": "p_name",
        "mengeneinheit": "'Stk'",
        "mengentyp": "NULL",
        "gpfaktor": "1",
        "wgr": _ARTICLE_GROUP,
        "rabatt_kz": "'J'",
        "preisgebunden_kz": "'N'",
        "fsk_kz": "'N'",
        "notizen": "NULL",
    },
    "groups": {
        "wgr": _ARTICLE_GROUP,
        "wgr_bez": "p_brand || ' ' || p_size",
        "mwst_kz": _VAT.format(step="{step}", a="'4'", b="'9'", c="'0'"),
        "mwst_satz": _VAT.format(step="{step}", a="19", b="7", c="0"),
        "rabatt_kz": "CASE WHEN p_size < 25 THEN 'J' END",
        "fsk_kz": "'N'",
    },
    "multi_ean": {"ean_m": "p_partkey * 10 + 1", "ean_h": "p_partkey + {step}"},
    "deposits": {
        "art_nr": "p_partkey",
        "pfand_bez": "p_name",
        "pfand_brutto": _PRICE,
        "hinweispflicht": "'J'",
        "wgr": _ARTICLE_GROUP,
        "wgr_bez": "p_brand",
    },
    "supplier_articles": {
        "ean": "l_partkey",
        "lief_nr": "l_suppkey",
        "lief_art_nr": "l_partkey || '-' || l_suppkey",
        "ek_netto": "CAST(preis AS DECIMAL(18,5)) + {step}",
    },
    "press_articles": {
        "art_nr": "p_partkey",
        "idx": "0",
        "scs_pool_id": "p_partkey",
        "art_bez": "p_name",
        "mengenfaktor": "1",
        "vk_brutto": _PRICE,
        "preiseinheit": "1",
        "kurzcode": "NULL",
        "bontext": "NULL",
        "mengeneinheit": "NULL",
        "mengentyp": "NULL",
        "gpfaktor": "NULL",
        "wgr": _PRESS_GROUP,
        "rabatt_kz": "'N'",
        "preisgebunden_kz": "'J'",
        "fsk_kz": "'N'",
        "notizen": "NULL",
    },
    "press_supplier_articles": {
        "ean": "p_partkey",
        "lief_nr": "'34'",
        "lief_art_nr": "p_partkey",
        "ek_netto": "CAST(p_retailprice AS DECIMAL(18,5)) + {step}",
    },
}


def stage(load: str, day: date, where: str = "TRUE", step: str = "0") -> str:
    export, pair = frames.LOADS[load]
    spec = EXPORTS[export]
    shape = PAIRS[pair]
    diff = next(t.diff for t in spec.targets if t.pair == pair)
    if load == "deposits":
        where += " AND p_type = 'SMALL'"
    kinds = {**shape.keys, **shape.attributes}
    rows = ", ".join(
        f"CAST({ROWS[load][n].format(step=f'({step})')} AS {typed(k)}) AS {n}" for n, k in kinds.items()
    )
    out = []
    for name in stage_columns(shape):
        if name == "preiseinheit" and load == "articles":
            out.append("CASE WHEN preiseinheit = 0 THEN 1 ELSE preiseinheit END AS preiseinheit")
        elif name == "hash":
            out.append(f"{hashed(shape.keys)} AS hash")
        elif name == "hash_diff":
            out.append(f"{hashed(diff)} AS hash_diff")
        elif name == "quelle":
            out.append(f"'{spec.quelle}' AS quelle")
        elif name == "eintrag_ts":
            out.append(f"TIMESTAMP '{frames.load_time_of(day)}' AS eintrag_ts")
        elif name == "export_datum":
            out.append(f"DATE '{day}' AS export_datum")
        else:
            out.append(name)
    source = SOURCES.get(export, "part")
    return f"SELECT {', '.join(out)} FROM (SELECT {rows} FROM {source} AS q WHERE {where})"


def snapshot_list(load: str, days=frames.DATES) -> list[str]:
    made = frames.INPUTS[frames.LOADS[load][0]]
    one = f"CASE WHEN {made.step_1} THEN 1 ELSE 0 END"
    two = f"CASE WHEN {made.step_2} THEN 2 WHEN {made.step_1} THEN 1 ELSE 0 END"
    return [
        stage(load, days[0], f"NOT ({made.missing_1})"),
        stage(load, days[1], f"NOT ({made.missing_2})", one),
        stage(load, days[2], "TRUE", two),
    ]


def snapshots(load: str, days=frames.DATES) -> str:
    return " UNION ALL ".join(f"({s})" for s in snapshot_list(load, days))


# --- typed export lines: what the reader has to make of the texts ---------------------

PRICE = "CAST(p_retailprice AS DECIMAL(18,2))"
PARSED = {
    "articles": f"""SELECT p_partkey AS scs_pool_id, '00' || p_partkey AS art_nr, 0::INTEGER AS idx, p_name || '€' AS art_bez,
        1.5::DECIMAL(18,3) AS mengenfaktor, {PRICE} AS vk_brutto,
        CASE WHEN p_size <= 40 THEN p_size::INTEGER END AS preiseinheit, p_type AS kurzcode, NULL::VARCHAR AS bontext,
        'Stk' AS mengeneinheit, NULL::VARCHAR AS mengentyp, 1000::DECIMAL(18,3) AS gpfaktor, p_brand AS wgr,
        p_size::VARCHAR AS uwgr, 'J' AS rabatt_kz, 'N' AS preisgebunden_kz, NULL::VARCHAR AS fsk_kz, 'A–B' AS notizen
        FROM part""",
    "customers": """SELECT c_custkey::VARCHAR AS kdnr, CASE WHEN c_nationkey <> 3 THEN c_name || ' Müller' END AS kd_name,
        CAST(c_nationkey * 0.25 AS DECIMAL(5,2)) AS rabatt_satz FROM customer""",
    "suppliers": """SELECT s_suppkey::VARCHAR AS lief_nr, 'K' || s_suppkey AS lief_kdnr, s_name AS lief_name,
        s_nationkey::VARCHAR AS ek_art_uebernahme, CASE WHEN s_acctbal > 0 THEN 'J' ELSE 'N' END AS ist_hauptlief,
        NULL::VARCHAR AS art_import_logik FROM supplier""",
    "multi_ean": "SELECT DISTINCT (l_partkey * 10 + 1)::VARCHAR AS ean_m, l_partkey::VARCHAR AS ean_h FROM lineitem",
    "deposits": f"""SELECT p_name AS pfand_bez, {PRICE} AS pfand_brutto, 'J' AS hinweispflicht, p_brand AS wgr,
        p_size::VARCHAR AS uwgr, p_brand || 'Œ' AS wgr_bez, CASE WHEN p_type = 'SMALL' THEN p_partkey::VARCHAR END AS art_nr
        FROM part""",
    "press_articles": f"""SELECT p_partkey::VARCHAR AS art_nr, p_name AS art_bez,
        CAST({PRICE} * 0.01 AS DECIMAL(18,5)) AS ek_netto, {PRICE} AS vk_brutto, (p_size % 4)::VARCHAR AS mwst_kz,
        'N' AS fsk_kz FROM part""",
    "supplier_articles": """SELECT l_partkey || '-' || l_suppkey AS lief_art_nr, l_partkey::VARCHAR AS ean,
        l_suppkey::VARCHAR AS lief_nr, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,5)) AS ek_netto
        FROM lineitem""",
    "groups": """SELECT p_brand AS wgr, p_size::VARCHAR AS uwgr, p_brand AS wgr_bez, (p_size % 3)::VARCHAR AS mwst_kz,
        CASE WHEN p_size < 25 THEN 'J' END AS rabatt_kz, 'N' AS fsk_kz FROM part""",
    "journal": """SELECT (o_custkey % 3 + 1)::INTEGER AS kasse_nr, l_orderkey AS bon_nr, t AS bon_abschluss,
        CASE WHEN o_orderstatus <> 'F' THEN t - INTERVAL 5 MINUTE END AS bon_beginn,
        'A' || (o_custkey % 50) || ' | Kasse' AS ma, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS kdnr,
        CAST(o_totalprice AS DECIMAL(18,2)) AS bon_summe, CASE l_returnflag WHEN 'R' THEN 'RN | Position' ELSE 'BV' END AS typ,
        CASE l_returnflag WHEN 'R' THEN '-' ELSE l_partkey::VARCHAR END AS art_nr, 'Artikel ' || l_partkey AS art_bez,
        l_suppkey || ':0 | Gruppe' AS warengruppe, CAST(round(l_tax * 100) AS DECIMAL(5,2)) AS mwst_satz,
        CASE WHEN l_linestatus <> 'F' THEN 1::DECIMAL(18,3) END AS mengenfaktor, CAST(l_quantity AS DECIMAL(18,3)) AS menge,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS preis_einzel,
        CAST(CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END * l_extendedprice AS DECIMAL(18,2)) AS preis_gesamt,
        NULL::VARCHAR AS infotext, NULL::VARCHAR AS storno_ref, o_orderstatus AS tse_info
        FROM (SELECT *, o_orderdate + to_hours(CAST(8 + o_custkey % 12 AS INTEGER)) AS t
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}

# --- hubs and satellites ----------------------------------------------------------


def hub(load: str, seen: str, stages: str | None = None) -> str:
    # Sources of one date follow each other by load time and name.
    order = "strftime(export_datum, '%Y%m%d') || strftime(eintrag_ts, '%Y%m%d%H%M%S') || quelle"
    keys = ", ".join(f"arg_min({k}, {order}) AS {k}" for k in frames.pair_of(load).keys)
    return f"""SELECT hash, min(eintrag_ts) AS eintrag_ats, min(export_datum) AS gueltig_adtm,
        {seen}(export_datum) AS zuletzt_gesehen, arg_min(quelle, {order}) AS quelle, {keys}
        FROM ({stages or snapshots(load)}) GROUP BY hash"""


def sat(load: str, stages: str | None = None) -> str:
    attributes = ", ".join(frames.pair_of(load).attributes)
    return f"""SELECT hash, hash_diff, eintrag_ts AS eintrag_ats,
        coalesce(lead(eintrag_ts) OVER w, TIMESTAMP '2099-12-31 23:59:59') AS eintrag_ets,
        export_datum AS gueltig_adtm,
        coalesce(lead(export_datum) OVER w, DATE '2099-12-31') AS gueltig_edtm,
        lead(export_datum) OVER w IS NULL AS gueltig, quelle, {attributes}
        FROM (SELECT *, lag(hash_diff) OVER (PARTITION BY hash ORDER BY export_datum) AS vorher
              FROM ({stages or snapshots(load)}))
        WHERE vorher IS NULL OR vorher <> hash_diff
        WINDOW w AS (PARTITION BY hash ORDER BY export_datum)"""


def sat_all_closed(load: str) -> str:
    """Every closed version ends when the key last changed."""
    return f"""WITH s AS ({sat(load)})
        SELECT * EXCLUDE (eintrag_ets, gueltig_edtm),
        CASE WHEN gueltig THEN eintrag_ets
             ELSE max(CASE WHEN NOT gueltig THEN eintrag_ets END) OVER k END AS eintrag_ets,
        CASE WHEN gueltig THEN gueltig_edtm
             ELSE max(CASE WHEN NOT gueltig THEN gueltig_edtm END) OVER k END AS gueltig_edtm
        FROM s WINDOW k AS (PARTITION BY hash)"""


def current(load: str) -> str:
    pair = frames.pair_of(load)
    return f"""SELECT hash, {', '.join(pair.keys)}, gueltig_adtm, {', '.join(pair.attributes)}
        FROM ({hub(load, 'max')}) h JOIN (
            SELECT * EXCLUDE (quelle, eintrag_ats) RENAME (gueltig_adtm AS ab) FROM ({sat(load)}) WHERE gueltig
        ) s USING (hash)""".replace("gueltig_adtm, " + ", ".join(pair.attributes), "s.ab AS gueltig_adtm, " + ", ".join(pair.attributes))


# --- till journal -----------------------------------------------------------------

LINES = """
 l AS (
  SELECT CAST(o_custkey % 3 + 1 AS INTEGER) AS kasse_nr, l_orderkey AS bon_nr,
   o_orderdate + to_hours(CAST(8 + o_custkey % 12 AS INTEGER)) AS bon_abschluss, o_orderstatus,
   (o_custkey % 50) || ' | Kasse' AS ma,
   CASE WHEN o_orderpriority = '1-URGENT' THEN '0' ELSE CAST(o_custkey AS VARCHAR) END AS kdnr,
   CAST(o_totalprice AS DECIMAL(18,2)) AS bon_summe,
   CASE l_returnflag WHEN 'R' THEN 'RN | Position' WHEN 'N' THEN 'BV' ELSE 'BV | Position' END AS typ,
   CASE l_returnflag WHEN 'R' THEN 'RN' ELSE 'BV' END AS bon_typ,
   CASE l_returnflag WHEN 'N' THEN NULL ELSE 'Position' END AS pos_typ,
   CASE WHEN l_returnflag = 'R' THEN '-' ELSE CAST(l_partkey AS VARCHAR) END AS art_nr,
   CASE WHEN l_tax < 0.03 THEN 'EINZAHLUNG bar' WHEN l_tax < 0.05 THEN 'Auszahlung'
        ELSE 'Artikel ' || l_partkey END AS art_bez,
   CASE WHEN l_quantity <= 4 THEN 'WGR fehlt' ELSE l_suppkey || ':0 | Gruppe ' || l_suppkey END AS warengruppe,
   CAST(round(l_tax * 100) AS DECIMAL(5,2)) AS mwst_satz, CAST(1 AS INTEGER) AS mengenfaktor,
   CAST(l_quantity AS DECIMAL(18,3)) AS menge, CAST(l_extendedprice AS DECIMAL(18,2)) AS preis_einzel,
   CASE WHEN l_quantity <= 4 AND l_discount = 0 THEN CAST(0 AS DECIMAL(18,2))
        ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS preis_gesamt,
   CAST(NULL AS VARCHAR) AS infotext, CAST(NULL AS VARCHAR) AS storno_ref, o_orderstatus AS tse_info,
   CAST(row_number() OVER (PARTITION BY {group} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 j AS (
  SELECT *, md5(kasse_nr || ':' || bon_nr || ':' || pos) AS hash, md5(kasse_nr || ':' || bon_nr) AS hash_bon,
   TIMESTAMP '{ts}' AS eintrag_ts,
   CASE WHEN o_orderstatus = 'F' THEN bon_abschluss ELSE bon_abschluss - INTERVAL 5 MINUTE END AS bon_beginn
  FROM l)"""

# A receipt is any of its lines, one of another type than RN if it has one.
_RECEIPT = ", ".join(RECEIPT_COLUMNS)
RECEIPTS = f"""
 b AS (SELECT {_RECEIPT}
       FROM (SELECT * EXCLUDE (hash), hash_bon AS hash, CAST(bon_abschluss AS DATE) AS bon_datum FROM j)
       QUALIFY row_number() OVER (PARTITION BY hash ORDER BY bon_typ = 'RN', pos) = 1)"""

POSITION_ROWS = """
 g AS (SELECT *,
   CASE WHEN warengruppe ILIKE '%fehlt%' AND art_bez ILIKE '%auszahlung%' AND preis_gesamt <> 0 THEN '9001:2'
        WHEN warengruppe ILIKE '%fehlt%' AND art_bez ILIKE '%einzahlung%' AND preis_gesamt <> 0 THEN '9001:1'
        WHEN warengruppe ILIKE '%fehlt%' THEN '0:0'
        ELSE trim(split_part(warengruppe, '|', 1)) END AS wgr,
   CASE WHEN contains(warengruppe, '|') THEN trim(split_part(warengruppe, '|', 2)) END AS wgr_bez,
   trim(split_part(ma, '|', 1)) AS ma_id
  FROM j),
 p AS (SELECT *, coalesce(
   last_value(CASE WHEN art_nr <> '-' THEN hash END IGNORE NULLS) OVER (ORDER BY kasse_nr, bon_nr, pos
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   first_value(hash) OVER (ORDER BY kasse_nr, bon_nr, pos)) AS hash_fuehrend
  FROM g)"""


def journal(select: str, *parts: str, ts=frames.JOURNAL_TS, group: str = "l_orderkey") -> str:
    return f"WITH {','.join([LINES.format(ts=ts, group=group), *parts])} {select}"


def _reloaded(table: str, day: str) -> str:
    early = f"{day} < DATE '{catalog.SPLIT_DAY}'"
    return f"CASE WHEN {early} THEN TIMESTAMP '{frames.JOURNAL_TS}' ELSE TIMESTAMP '{frames.RELOAD_TS}' END AS eintrag_ts"


def _order_aid(suppliers: str) -> str:
    days = ", ".join(
        f"""CAST(CAST(coalesce(sum(menge) FILTER (WHERE isodow(bon_datum) = {i}), 0) AS DOUBLE)
            / {catalog.ORDER_WEEKS} AS DECIMAL(18,3)) AS {name}"""
        for i, name in enumerate(("mo", "di", "mi", "do", "fr", "sa", "so"), start=1)
    )
    return journal(
        f"""SELECT art_nr, {days} FROM g JOIN b ON g.hash_bon = b.hash WHERE wgr IN (SELECT s_suppkey || ':0' FROM supplier WHERE {suppliers})
        AND bon_datum >= DATE '{catalog.ORDER_UNTIL}' - INTERVAL {catalog.ORDER_WEEKS * 7} DAY
        AND bon_datum < DATE '{catalog.ORDER_UNTIL}' GROUP BY art_nr""",
        RECEIPTS,
        POSITION_ROWS,
    )


def _order_aid_open_days() -> str:
    days = ", ".join(
        f"""CAST(CAST(coalesce(sum(menge) FILTER (WHERE isodow(bon_datum) = {i}), 0) AS DOUBLE)
            / (SELECT nullif(count(DISTINCT bon_datum), 0) FROM o WHERE isodow(bon_datum) = {i}) AS DECIMAL(18,3)) AS {name}"""
        for i, name in enumerate(("mo", "di", "mi", "do", "fr", "sa", "so"), start=1)
    )
    return journal(
        f"""SELECT art_nr, {days} FROM g JOIN o ON g.hash_bon = o.hash
        WHERE wgr IN (SELECT s_suppkey || ':0' FROM supplier WHERE {catalog.BAKERY}) GROUP BY art_nr""",
        RECEIPTS,
        POSITION_ROWS,
        f"""o AS (SELECT * FROM b WHERE bon_datum >= DATE '{catalog.ORDER_UNTIL}' - INTERVAL {catalog.ORDER_WEEKS * 7} DAY
        AND bon_datum < DATE '{catalog.ORDER_UNTIL}' AND day(bon_datum) % 5 <> 0 AND isodow(bon_datum) <> 1)""",
    )


_CALENDAR = """CAST(year(datum) AS INTEGER) AS jahr, CAST(month(datum) AS INTEGER) AS monat,
    CAST(day(datum) AS INTEGER) AS tag, CAST(isodow(datum) AS INTEGER) AS wtag, CAST(week(datum) AS INTEGER) AS kw"""


def oracles() -> dict[str, str]:
    found: dict[str, str] = {f"parse_{export}": sql for export, sql in PARSED.items()}
    for load in frames.LOADS:
        found[f"stage_{load}"] = stage(load, frames.DATES[0])
        found[f"hub_load_{load}"] = hub(load, "min")
        found[f"hub_touch_{load}"] = hub(load, "max")
        found[f"hub_bulk_{load}"] = hub(load, "max")
        found[f"sat_history_{load}"] = sat(load)
        found[f"sat_bulk_{load}"] = sat(load)

    articles = frames.pair_of("articles")
    found["sat_idempotent"] = sat("articles", stage("articles", frames.DATES[0]))
    found["sat_close_all_versions"] = sat_all_closed("articles")
    found["sat_two_sources"] = sat(
        "articles", f"({stage('articles', frames.DATES[0])}) UNION ALL ({stage('press_articles', frames.DATES[1])})"
    )
    same_day = f"({stage('articles', frames.DATES[0])}) UNION ALL ({stage('press_articles', frames.DATES[0])})"
    found["hub_two_sources"] = hub("articles", "max", same_day)
    found["current_view"] = current("customers")
    found["asof_view"] = f"""SELECT h.hash, h.art_nr, s.gueltig_adtm, s.gueltig_edtm,
        {', '.join('s.' + a for a in articles.attributes)}
        FROM ({hub('articles', 'max')}) h JOIN ({sat('articles')}) s USING (hash)
        WHERE s.gueltig_adtm <= DATE '{catalog.AS_OF_DAY}' AND DATE '{catalog.AS_OF_DAY}' < s.gueltig_edtm"""

    found["journal_positions"] = journal(f"SELECT {', '.join(JOURNAL)} FROM j")
    found["journal_per_till"] = journal(
        "SELECT hash, kasse_nr, bon_nr, pos FROM j", group="o_custkey % 3, l_orderkey"
    )
    day = "CAST(bon_abschluss AS DATE)"
    found["journal_anti_load"] = journal(
        f"SELECT {', '.join(JOURNAL)} FROM (SELECT * REPLACE ({_reloaded('j', day)}) FROM j)"
    )
    found["journal_filtered_load"] = journal(
        f"""SELECT {', '.join(JOURNAL)} FROM (SELECT * REPLACE ({_reloaded('j', day)}) FROM j)
        WHERE NOT {day} < DATE '{catalog.SPLIT_DAY}'
          AND bon_nr IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= DATE '{catalog.SPLIT_DAY}')"""
    )
    found["receipt_type"] = journal(
        """SELECT DISTINCT kasse_nr, bon_nr, bon_typ, if(bon_typ = 'RN', -1, 1) AS rang FROM j
        QUALIFY bon_typ <> 'RN' OR bool_and(bon_typ = 'RN') OVER (PARTITION BY hash_bon)"""
    )
    found["receipt_headers"] = journal(
        """SELECT eintrag_ts, kasse_nr, bon_nr, bon_beginn, bon_abschluss, bon_summe, kdnr, tse_info, storno_ref
        FROM j GROUP BY ALL"""
    )
    found["receipts"] = journal(f"SELECT {_RECEIPT} FROM b", RECEIPTS)
    found["receipts_load"] = journal(
        f"SELECT {_RECEIPT} FROM (SELECT * REPLACE ({_reloaded('b', 'bon_datum')}) FROM b)", RECEIPTS
    )
    found["positions"] = journal(f"SELECT {', '.join(POSITIONS)} FROM p", POSITION_ROWS)
    found["positions_groups"] = journal(
        "SELECT hash, hash_bon, wgr, wgr_bez, ma_id, preis_gesamt FROM g", POSITION_ROWS
    )
    found["positions_load"] = journal(
        f"SELECT {', '.join(POSITIONS)} FROM (SELECT * REPLACE ({_reloaded('p', day)}) FROM p)", POSITION_ROWS
    )
    found["leading_position"] = journal(
        "SELECT hash, kasse_nr, bon_nr, pos, art_nr, hash_fuehrend FROM p", POSITION_ROWS
    )
    days = journal(f"SELECT datum, {_CALENDAR} FROM (SELECT DISTINCT {day} AS datum FROM j)")
    found["calendar"] = days
    found["calendar_load"] = days
    found["key_violations"] = """SELECT l_orderkey, l_linenumber, count(*) AS zeilen FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
    found["months"] = journal("SELECT DISTINCT strftime(bon_datum, '%Y-%m') AS monat FROM b ORDER BY 1", RECEIPTS)
    found["last_change"] = journal(
        f"SELECT max(eintrag_ts) AS zeitpunkt FROM (SELECT {_reloaded('b', 'bon_datum')} FROM b)", RECEIPTS
    )
    found["last_file_plain"] = f"SELECT max(zuletzt_gesehen) AS zeitpunkt FROM ({hub('customers', 'max')})"
    both = f"({snapshot_list('articles')[0]}) UNION ALL ({snapshot_list('press_articles')[2]})"
    found["last_file_by_source"] = f"""SELECT max(zuletzt_gesehen) AS zeitpunkt FROM ({hub('articles', 'max', both)})
        WHERE quelle = 'scs_export_presseartikel'"""

    found["asof_sale"] = journal(
        f"""SELECT p.hash, p.art_nr, p.menge, p.preis_gesamt, p.bon_datum,
        a.vk_brutto AS art_vk_brutto, a.wgr AS art_wgr
        FROM (SELECT *, {day} AS bon_datum FROM j) p
        LEFT JOIN (SELECT h.art_nr, s.* FROM ({hub('articles', 'max', snapshots('articles', frames.SALE_DATES))}) h
                   JOIN ({sat('articles', snapshots('articles', frames.SALE_DATES))}) s USING (hash)) a
        ON a.art_nr = p.art_nr AND a.gueltig_adtm <= p.bon_datum AND p.bon_datum < a.gueltig_edtm"""
    )
    found["ean_resolve"] = journal(
        f"""SELECT coalesce(m.ean_h, j.art_nr) AS art_nr, CAST(sum(menge) AS DECIMAL(18,3)) AS menge
        FROM j LEFT JOIN ({current('multi_ean')}) m ON m.ean_m = j.art_nr GROUP BY 1"""
    )
    found["voids"] = journal(
        """SELECT v.kasse_nr, v.bon_nr, s.hash AS hash_storno, s.bon_nr AS bon_nr_storno, s.bon_summe AS summe_storno,
        v.hash, v.bon_summe FROM b s JOIN b v ON s.kasse_nr = v.kasse_nr AND s.bon_nr - 1 = v.bon_nr
        WHERE s.bon_typ = 'RN'""",
        RECEIPTS,
    )
    found["voids_without_receipt"] = journal(
        """SELECT kasse_nr, if(kasse_nr = 2, 'Bon ', '') || (bon_nr - 1) AS storno_ref, hash AS hash_storno, bon_nr AS bon_nr_storno,
        if(kasse_nr = 2, 'nummer', 'bon') AS grund FROM b s
        WHERE bon_typ = 'RN' AND (kasse_nr = 2 OR NOT EXISTS (FROM b v WHERE v.kasse_nr = s.kasse_nr AND v.bon_nr = s.bon_nr - 1))""",
        RECEIPTS,
    )
    found["parse_rejects"] = """
        SELECT 'articles' AS export, '00' || p_partkey AS schluessel, concat_ws(',', if(p_type = 'SMALL', 'idx', NULL),
               if(p_size = 7, 'mengenfaktor', NULL), if(p_size > 45, 'vk_brutto', NULL)) AS fehler
        FROM part WHERE fehler <> ''
        UNION ALL SELECT 'customers', lpad(c_custkey::VARCHAR, 10, '0'), 'rabatt_satz' FROM customer WHERE c_acctbal > 5000
        UNION ALL SELECT 'journal', (o_custkey % 3 + 1)::VARCHAR, concat_ws(',', if(l_quantity = 3, 'bon_nr', NULL),
               if(l_tax = 0.07, 'bon_abschluss', NULL), if(l_discount = 0.05, 'menge', NULL)) AS fehler
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE fehler <> ''"""
    found["parse_accepted"] = f"""SELECT * REPLACE (if(uwgr = '8', '?', art_bez) AS art_bez) FROM ({PARSED["articles"]})
        WHERE kurzcode <> 'SMALL' AND uwgr <> '7' AND uwgr::INTEGER <= 45"""
    found["order_aid_bakery"] = _order_aid(catalog.BAKERY)
    found["order_aid_meat"] = _order_aid(catalog.MEAT)
    found["order_aid_open_days"] = _order_aid_open_days()
    found["inventory_articles"] = f"""SELECT a.art_nr, a.art_bez, a.mengeneinheit, a.vk_brutto, a.wgr, g.wgr_bez,
        g.mwst_satz, d.pfand_brutto FROM ({current('articles')}) a
        LEFT JOIN ({current('groups')}) g ON g.wgr = a.wgr LEFT JOIN ({current('deposits')}) d ON d.art_nr = a.art_nr
        WHERE a.wgr NOT IN ('9999:0', '9998:0', '9997:0')"""
    found["inventory_supplier_articles"] = f"""SELECT x.ean, x.lief_nr, l.lief_name, x.lief_art_nr, x.ek_netto,
        a.art_bez, a.vk_brutto FROM ({current('supplier_articles')}) x
        LEFT JOIN ({current('suppliers')}) l ON l.lief_nr = x.lief_nr
        LEFT JOIN ({current('articles')}) a ON a.art_nr = x.ean"""
    found["card_mix"] = journal(
        """SELECT bon_typ, pos_typ, strftime(bon_abschluss, '%Y-%m') AS monat,
        count(DISTINCT kasse_nr || ':' || bon_nr) AS bons, count(*) AS positionen,
        CAST(sum(preis_gesamt) AS DECIMAL(18,2)) AS summe FROM j GROUP BY 1, 2, 3"""
    )
    found["visits_by_hour"] = journal(
        """SELECT CAST(isodow(bon_datum) AS INTEGER) AS wtag, CAST(hour(bon_abschluss) AS INTEGER) AS stunde,
        count(*) AS besuche, CAST(sum(bon_summe) AS DECIMAL(18,2)) AS summe FROM b GROUP BY 1, 2""",
        RECEIPTS,
    )
    found["visits_by_customer"] = journal(
        """SELECT kdnr, strftime(bon_datum, '%Y-%m') AS monat, count(*) AS besuche,
        CAST(sum(bon_summe) AS DECIMAL(18,2)) AS summe FROM b GROUP BY 1, 2""",
        RECEIPTS,
    )
    found["month_totals"] = journal(
        """SELECT strftime(bon_abschluss, '%Y-%m') AS monat, count(DISTINCT hash_bon) AS bons, count(*) AS positionen,
        CAST(sum(menge) AS DECIMAL(18,3)) AS menge, CAST(sum(preis_gesamt) AS DECIMAL(18,2)) AS umsatz
        FROM j GROUP BY 1"""
    )
    return found
