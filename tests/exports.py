"""Rows for export files: ``row('articles', Strichcode='4711')`` fills the rest."""

from __future__ import annotations

from tillvault.schemas import EXPORTS

DEFAULTS = {
    "articles": {
        "SCSPoolID": "1",
        "Strichcode": "4711",
        "Index": "0",
        "Bezeichnung": "Brötchen",
        "Mengenfaktor": "1,5",
        "VKPreis": "0,45",
        "Preiseinheit": "0",
        "Mengeneinheit": "Stk",
        "GPFaktor": "1,000",
        "WGR": "10",
        "UWGR": "2",
        "RabattKZ": "J",
    },
    "customers": {"KDNR": "100", "Name": "Müller", "Rabattsatz": "2,5"},
    "suppliers": {"LiefNr": "7", "KDNR": "K7", "Name": "Großhandel", "IsHauptLief": "J"},
    "multi_ean": {"Mehrfach-EAN": "900", "Haupt-EAN": "4711"},
    "deposits": {
        "Bezeichnung": "Kiste",
        "Wert": "3,10",
        "Hinweispflicht": "J",
        "WGR": "20",
        "UWGR": "1",
        "WGR-Bezeichnung": "Pfand",
        "Strichcode": "5000",
    },
    "press_articles": {
        "PrStrichcode": "4190001",
        "Titel": "Tageblatt",
        "EKPreis": "1,234",
        "VKPreis": "2,00",
        "MwStID": "9",
        "IsFSK": "N",
    },
    "supplier_articles": {"LiefArtNr": "A1", "EAN": "4711", "LiefNr": "7", "EKPreis": "0,321"},
    "groups": {
        "WGR_NR": "10",
        "UWGR-NR": "2",
        "Bezeichnung": "Backwaren",
        "MwSt.-KZ": "9",
        "Rabatt": "J",
        "FSKKZ": "0",
    },
    "journal": {
        "Kassen-Nr.": "1",
        "Bon-Nr.": "1",
        "Zeitpunkt": "30.12.2024 10:05:00",
        "Beginn": "30.12.2024 10:00:00",
        "Verkäufer": "5 | Anna",
        "Kunden-Nr.": "100",
        "Bon-Summe": "9,90",
        "Typ": "BV | Artikel",
        "Artikelnummer": "4711",
        "Bezeichnung": "Brötchen",
        "Warengruppe": "10:2 | Backwaren",
        "MwSt.-Satz": "7,00",
        "Mengenfaktor": "1",
        "Menge": "2,000",
        "Preis": "0,45",
        "Gesamt": "0,90",
    },
}


def header(export: str) -> list[str]:
    return list(EXPORTS[export].columns)


def row(export: str, **values: str) -> list[str]:
    """One line. Keys are table columns (``art_nr``), as header names are no identifiers."""
    names = {column: head for head, (column, _) in EXPORTS[export].columns.items()}
    unknown = set(values) - set(names)
    assert not unknown, unknown
    line = {**DEFAULTS[export], **{names[c]: v for c, v in values.items()}}
    return [line.get(head, "") for head in header(export)]
