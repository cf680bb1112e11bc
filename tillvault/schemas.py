"""Table shapes and export layouts.

Everything here is data: which columns a file has, how they are typed, which of
them make up the business key and which take part in the change hash. The
operators are generic over these specs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Open end of validity: fixed values of the data model.
OPEN_TS = "2099-12-31 23:59:59"
OPEN_DATE = "2099-12-31"


@dataclass(frozen=True)
class Pair:
    """A hub with its satellite: business key columns and described attributes."""

    name: str
    keys: dict[str, str]
    attributes: dict[str, str]

    @property
    def hub(self) -> str:
        return f"hub_{self.name}_t"

    @property
    def sat(self) -> str:
        return f"sat_{self.name}_t"


@dataclass(frozen=True)
class Target:
    """One staging output of an export: the pair it feeds and its change-hash columns."""

    pair: str
    diff: tuple[str, ...]


@dataclass(frozen=True)
class Export:
    """An export file: header name -> (column, kind); see ``functions.german.KINDS``."""

    name: str
    quelle: str | None
    encoding: str
    columns: dict[str, tuple[str, str]]
    targets: tuple[Target, ...] = ()
    distinct: bool = False


# --- fixed values: table columns ------------------------------------------------

PAIRS = {
    p.name: p
    for p in (
        Pair(
            "warengruppen",
            {"wgr": "string"},
            {
                "wgr_bez": "string",
                "mwst_kz": "string",
                "mwst_satz": "decimal(5,2)",
                "rabatt_kz": "string",
                "fsk_kz": "string",
            },
        ),
        Pair("kunden", {"kdnr": "string"}, {"kd_name": "string", "rabatt_satz": "decimal(5,2)"}),
        Pair(
            "artikel",
            {"art_nr": "string"},
            {
                "idx": "int",
                "scs_pool_id": "bigint",
                "art_bez": "string",
                "mengenfaktor": "decimal(18,3)",
                "vk_brutto": "decimal(18,2)",
                "preiseinheit": "int",
                "kurzcode": "string",
                "bontext": "string",
                "mengeneinheit": "string",
                "mengentyp": "string",
                "gpfaktor": "decimal(18,3)",
                "wgr": "string",
                "rabatt_kz": "string",
                "preisgebunden_kz": "string",
                "fsk_kz": "string",
                "notizen": "string",
            },
        ),
        Pair(
            "pfand",
            {"art_nr": "string"},
            {
                "pfand_bez": "string",
                "pfand_brutto": "decimal(18,2)",
                "hinweispflicht": "string",
                "wgr": "string",
                "wgr_bez": "string",
            },
        ),
        Pair(
            "lieferanten",
            {"lief_nr": "string"},
            {
                "lief_kdnr": "string",
                "lief_name": "string",
                "ek_art_uebernahme": "string",
                "ist_hauptlief": "string",
                "art_import_logik": "string",
            },
        ),
        Pair("mean", {"ean_m": "string"}, {"ean_h": "string"}),
        Pair(
            "scs_liefart",
            {"ean": "string", "lief_nr": "string"},
            {"lief_art_nr": "string", "ek_netto": "decimal(18,5)"},
        ),
    )
}

JOURNAL = {
    "hash": "string",
    "eintrag_ts": "timestamp_ntz",
    "kasse_nr": "int",
    "bon_nr": "bigint",
    "pos": "int",
    "bon_beginn": "timestamp_ntz",
    "bon_abschluss": "timestamp_ntz",
    "ma": "string",
    "kdnr": "string",
    "bon_summe": "decimal(18,2)",
    "typ": "string",
    "bon_typ": "string",
    "pos_typ": "string",
    "art_nr": "string",
    "art_bez": "string",
    "warengruppe": "string",
    "mwst_satz": "decimal(5,2)",
    "mengenfaktor": "int",
    "menge": "decimal(18,3)",
    "preis_einzel": "decimal(18,2)",
    "preis_gesamt": "decimal(18,2)",
    "infotext": "string",
    "storno_ref": "string",
    "tse_info": "string",
}

RECEIPTS = {
    "hash": "string",
    "eintrag_ts": "timestamp_ntz",
    "kasse_nr": "int",
    "bon_nr": "bigint",
    "bon_typ": "string",
    "bon_beginn": "timestamp_ntz",
    "bon_abschluss": "timestamp_ntz",
    "bon_datum": "date",
    "kdnr": "string",
    "bon_summe": "decimal(18,2)",
    "tse_info": "string",
    "storno_ref": "string",
}

POSITIONS = {
    "hash": "string",
    "hash_bon": "string",
    "hash_fuehrend": "string",
    "eintrag_ts": "timestamp_ntz",
    "kasse_nr": "int",
    "bon_nr": "bigint",
    "pos": "int",
    "pos_typ": "string",
    "art_nr": "string",
    "art_bez": "string",
    "mwst_satz": "decimal(5,2)",
    "mengenfaktor": "int",
    "menge": "decimal(18,3)",
    "preis_einzel": "decimal(18,2)",
    "preis_gesamt": "decimal(18,2)",
    "wgr": "string",
    "wgr_bez": "string",
    "ma_id": "string",
}

CALENDAR = {
    "datum": "date",
    "jahr": "int",
    "monat": "int",
    "tag": "int",
    "wtag": "int",
    "kw": "int",
}

# Files taken in from a drop folder; no part of the original's tables.
FILES = {
    "export": "string",
    "export_datum": "date",
    "pfad": "string",
    "zeit": "timestamp_ntz",
    "stand": "string",
    "grund": "string",
}

# Lines of exports that a load has set aside.
BAD_LINES = {
    "export": "string",
    "export_datum": "date",
    "pfad": "string",
    "zeile": "string",
    "fehler": "string",
}

# --- fixed values: export layouts ----------------------------------------------

_CP1252 = "cp1252"

EXPORTS = {
    e.name: e
    for e in (
        Export(
            "articles",
            "scs_export_artikel",
            _CP1252,
            {
                "SCSPoolID": ("scs_pool_id", "bigint"),
                "Strichcode": ("art_nr", "text"),
                "Index": ("idx", "int"),
                "Bezeichnung": ("art_bez", "text"),
                "Mengenfaktor": ("mengenfaktor", "decimal(18,3)"),
                "VKPreis": ("vk_brutto", "decimal(18,2)"),
                "Preiseinheit": ("preiseinheit", "int"),
                "Kurzcode": ("kurzcode", "text"),
                "Bontext": ("bontext", "text"),
                "Mengeneinheit": ("mengeneinheit", "text"),
                "Mengentyp": ("mengentyp", "text"),
                "GPFaktor": ("gpfaktor", "decimal(18,3)"),
                "WGR": ("wgr", "text"),
                "UWGR": ("uwgr", "text"),
                "RabattKZ": ("rabatt_kz", "text"),
                "PreisgebundenKZ": ("preisgebunden_kz", "text"),
                "FSKKZ": ("fsk_kz", "text"),
                "Notizen": ("notizen", "text"),
            },
            (
                Target(
                    "artikel",
                    (
                        "scs_pool_id",
                        "idx",
                        "art_bez",
                        "mengenfaktor",
                        "vk_brutto",
                        "preiseinheit",
                        "kurzcode",
                        "bontext",
                        "mengeneinheit",
                        "mengentyp",
                        "gpfaktor",
                        "wgr",
                        "rabatt_kz",
                        "preisgebunden_kz",
                        "fsk_kz",
                        "notizen",
                    ),
                ),
            ),
        ),
        Export(
            "customers",
            "scs_export_kunden",
            _CP1252,
            {
                "KDNR": ("kdnr", "number_text"),
                "Name": ("kd_name", "text"),
                "Rabattsatz": ("rabatt_satz", "decimal(5,2)"),
            },
            (Target("kunden", ("kd_name", "rabatt_satz")),),
        ),
        Export(
            "suppliers",
            "scs_export_lieferanten",
            _CP1252,
            {
                "LiefNr": ("lief_nr", "bigint_text"),
                "KDNR": ("lief_kdnr", "text"),
                "Name": ("lief_name", "text"),
                "EKArtikeluebernahme": ("ek_art_uebernahme", "text"),
                "IsHauptLief": ("ist_hauptlief", "text"),
                "Artikelimport-Logik": ("art_import_logik", "text"),
            },
            (
                Target(
                    "lieferanten",
                    (
                        "lief_kdnr",
                        "lief_name",
                        "ek_art_uebernahme",
                        "ist_hauptlief",
                        "art_import_logik",
                    ),
                ),
            ),
        ),
        Export(
            "multi_ean",
            "scs_export_mehrfach-ean",
            _CP1252,
            {"Mehrfach-EAN": ("ean_m", "text"), "Haupt-EAN": ("ean_h", "text")},
            (Target("mean", ("ean_h",)),),
            distinct=True,
        ),
        Export(
            "deposits",
            "scs_export_pfand",
            _CP1252,
            {
                "Bezeichnung": ("pfand_bez", "text"),
                "Wert": ("pfand_brutto", "decimal(18,2)"),
                "Hinweispflicht": ("hinweispflicht", "text"),
                "WGR": ("wgr", "text"),
                "UWGR": ("uwgr", "text"),
                "WGR-Bezeichnung": ("wgr_bez", "text"),
                "Strichcode": ("art_nr", "text"),
            },
            (Target("pfand", ("pfand_bez", "pfand_brutto", "hinweispflicht", "wgr", "wgr_bez")),),
        ),
        Export(
            "press_articles",
            "scs_export_presseartikel",
            _CP1252,
            {
                "PrStrichcode": ("art_nr", "text"),
                "Titel": ("art_bez", "text"),
                "EKPreis": ("ek_netto", "decimal(18,5)"),
                "VKPreis": ("vk_brutto", "decimal(18,2)"),
                "MwStID": ("mwst_kz", "text"),
                "IsFSK": ("fsk_kz", "text"),
            },
            (
                Target(
                    "artikel",
                    (
                        "art_bez",
                        "vk_brutto",
                        "fsk_kz",
                        "scs_pool_id",
                        "mengenfaktor",
                        "preiseinheit",
                        "wgr",
                    ),
                ),
                Target("scs_liefart", ("lief_art_nr", "ek_netto")),
            ),
        ),
        Export(
            "supplier_articles",
            "scs_export_lieferantenartikel",
            _CP1252,
            {
                "LiefArtNr": ("lief_art_nr", "text"),
                "EAN": ("ean", "text"),
                "LiefNr": ("lief_nr", "text"),
                "EKPreis": ("ek_netto", "decimal(18,5)"),
            },
            (Target("scs_liefart", ("lief_art_nr", "ek_netto")),),
        ),
        Export(
            "groups",
            "scs_export_warengruppen",
            _CP1252,
            {
                "WGR_NR": ("wgr", "number_text"),
                "UWGR-NR": ("uwgr", "number_text"),
                "Bezeichnung": ("wgr_bez", "text"),
                "MwSt.-KZ": ("mwst_kz", "number_text"),
                "Rabatt": ("rabatt_kz", "text"),
                "FSKKZ": ("fsk_kz", "text"),
            },
            (Target("warengruppen", ("wgr_bez", "mwst_kz", "mwst_satz", "rabatt_kz", "fsk_kz")),),
        ),
        Export(
            "journal",
            None,
            "UTF-8",
            {
                "Kassen-Nr.": ("kasse_nr", "int"),
                "Bon-Nr.": ("bon_nr", "bigint"),
                "Zeitpunkt": ("bon_abschluss", "timestamp"),
                "Beginn": ("bon_beginn", "timestamp"),
                "Verkäufer": ("ma", "text"),
                "Kunden-Nr.": ("kdnr", "bigint"),
                "Bon-Summe": ("bon_summe", "decimal(18,2)"),
                "Typ": ("typ", "text"),
                "Artikelnummer": ("art_nr", "text"),
                "Bezeichnung": ("art_bez", "text"),
                "Warengruppe": ("warengruppe", "text"),
                "MwSt.-Satz": ("mwst_satz", "decimal(5,2)"),
                "Mengenfaktor": ("mengenfaktor", "decimal(18,3)"),
                "Menge": ("menge", "decimal(18,3)"),
                "Preis": ("preis_einzel", "decimal(18,2)"),
                "Gesamt": ("preis_gesamt", "decimal(18,2)"),
                "Infotext": ("infotext", "text"),
                "Stornoreferenz": ("storno_ref", "text"),
                "TSE-Info": ("tse_info", "text"),
            },
        ),
    )
}

# --- table layouts derived from the specs ---------------------------------------


def stage_columns(pair: Pair) -> dict[str, str]:
    return {
        "quelle": "string",
        "eintrag_ts": "timestamp_ntz",
        "export_datum": "date",
        "hash": "string",
        "hash_diff": "string",
        **pair.keys,
        **pair.attributes,
    }


def hub_columns(pair: Pair) -> dict[str, str]:
    return {
        "hash": "string",
        "eintrag_ats": "timestamp_ntz",
        "gueltig_adtm": "date",
        "zuletzt_gesehen": "date",
        "quelle": "string",
        **pair.keys,
    }


def sat_columns(pair: Pair) -> dict[str, str]:
    return {
        "hash": "string",
        "hash_diff": "string",
        "eintrag_ats": "timestamp_ntz",
        "eintrag_ets": "timestamp_ntz",
        "gueltig_adtm": "date",
        "gueltig_edtm": "date",
        "gueltig": "boolean",
        "quelle": "string",
        **pair.attributes,
    }


def struct(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))
