"""Business keys and change hashes (all JVM-side: concat, trim, md5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text of a missing value, the separator, and what counts as
# white space when a text is trimmed for hashing.
MISSING = "nan"
SEPARATOR = ":"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_BLANKS = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"  # as an SQL literal


def canonical_text(df: DataFrame, names: Sequence[str]) -> Column:
    """Columns as trimmed texts joined by ``:``; a null becomes the text ``nan``.

    Numbers must be integers or fixed-scale decimals, whose text form is stable;
    binary floats are refused.
    """
    schema, parts = df.schema, []
    for name in names:
        kind = schema[name].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            raise TypeError(f"{name}: cast to decimal before hashing")
        text = f"btrim(`{name}`, {_BLANKS})" if isinstance(kind, T.StringType) else f"cast(`{name}` AS string)"
        parts.append(f"coalesce({text}, '{MISSING}')")
    return F.expr(f"concat_ws('{SEPARATOR}', {', '.join(parts)})")


def business_key(df: DataFrame, names: Sequence[str]) -> Column:
    """md5 of the key text. A null single key gives null, which the stage check refuses."""
    if len(names) == 1:
        return F.md5(F.col(names[0]).cast("string"))
    return F.md5(canonical_text(df, names))


def change_hash(df: DataFrame, names: Sequence[str]) -> Column:
    return F.md5(canonical_text(df, names))


def receipt_key(kasse_nr: Column, bon_nr: Column) -> Column:
    return F.md5(F.concat_ws(SEPARATOR, kasse_nr, bon_nr))


def position_key(kasse_nr: Column, bon_nr: Column, pos: Column) -> Column:
    return F.md5(F.concat_ws(SEPARATOR, kasse_nr, bon_nr, pos))
