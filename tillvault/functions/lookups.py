"""Fixed code lists as CASE expressions (a handful of codes each: no join needed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# VAT code -> rate.
VAT_RATES = {4: "19.00", 9: "7.00"}
VAT_DEFAULT = "0.00"

# VAT code of a press article -> product group.
PRESS_GROUPS = {"9": "9999:0", "4": "9998:0", "0": "9997:0"}

# Product groups of cash movements without a group, by a word in
# the article text; the group of everything else without a group.
MISSING_WORD = "fehlt"
MOVEMENT_GROUPS = {"einzahlung": "9001:1", "auszahlung": "9001:2"}
NO_GROUP = "0:0"

# Fixed value: the receipt type that gives way to any other type.
WEAK_TYPE = "RN"

# Fixed value: the article number of a position that follows a leading one.
FOLLOWS = "-"


def _lookup(code: Column, table: dict, default: str) -> Column:
    result = F.lit(default)
    for key, value in table.items():
        result = F.when(code == key, F.lit(value)).otherwise(result)
    return result


def vat_rate(code: Column) -> Column:
    return _lookup(code.try_cast("int"), VAT_RATES, VAT_DEFAULT).cast("decimal(5,2)")


def press_group(code: Column) -> Column:
    return _lookup(code, PRESS_GROUPS, "")


def mentions(text: Column, word: str) -> Column:
    """Case-insensitive; a null text mentions nothing."""
    return F.coalesce(F.lower(text).contains(word), F.lit(False))


def position_group(group: Column, warengruppe: Column, art_bez: Column, amount: Column) -> Column:
    """The product group of a position once cash movements and gaps are filled in."""
    missing = mentions(warengruppe, MISSING_WORD)
    moved = F.coalesce(amount != 0, F.lit(True))
    result = group
    for word, value in MOVEMENT_GROUPS.items():
        result = F.when(missing & mentions(art_bez, word) & moved, F.lit(value)).otherwise(result)
    return F.when(mentions(result, MISSING_WORD), F.lit(NO_GROUP)).otherwise(result)


def type_rank(bon_typ: Column) -> Column:
    return F.when(bon_typ == WEAK_TYPE, F.lit(-1)).otherwise(F.lit(1))
