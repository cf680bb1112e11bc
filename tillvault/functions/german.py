"""Typed values out of German export text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "dd.MM.yyyy HH:mm:ss"

# The bytes 0x80-0x9F that cp1252 defines. Read as ISO-8859-1 they arrive as the
# control characters of the same number, so one translate() repairs them.
_C1 = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_FROM = "".join(raw for raw, char in _C1 if char)
_TO = "".join(char for _, char in _C1 if char)


def repair_cp1252(text: Column) -> Column:
    return F.translate(text, _FROM, _TO)


def decimal_comma(text: Column, kind: str, strict: bool = True) -> Column:
    """``1,50`` -> decimal. A thousands point is an error, as the cast raises; so are digits that do not fit.

    Whether they fit is read off the text, which no cast has rounded. An exponent
    does not fit. Not ``strict``: null in place of any error.
    """
    scale = int(kind.rstrip(")").partition(",")[2] or 0)
    said = F.replace(F.trim(text), F.lit(","), F.lit("."))
    fraction = F.rtrim(F.regexp_extract(said, r"\.(\d*)$", 1), F.lit("0"))
    lost = (F.length(fraction) > scale) | said.rlike("[eE]")
    if not strict:
        return F.when(~lost, said.try_cast(kind))
    refused = F.raise_error(F.concat(F.lit(f"does not fit {kind}: "), text)).cast(kind)
    return F.when(lost, refused).otherwise(said.cast(kind))


def timestamp(text: Column, strict: bool = True) -> Column:
    if strict:
        return F.to_timestamp_ntz(text, F.lit(TIMESTAMP_FORMAT))
    # The format's parts in the order of a timestamp text.
    iso = F.regexp_replace(text, r"^(\d{2})\.(\d{2})\.(\d{4}) (\d{2}:\d{2}:\d{2})$", "$3-$2-$1 $4")
    return F.when(iso != text, iso.try_cast("timestamp_ntz"))


def number_text(text: Column) -> Column:
    """Whole numbers lose leading zeros, any other text stays as it is."""
    return F.coalesce(F.trim(text).try_cast("bigint").cast("string"), text)


def parse(text: Column, kind: str, strict: bool = True) -> Column:
    """One export field by its declared kind (see ``schemas.Export``); not ``strict``: null where it is none of that kind."""

    def cast(to: str) -> Column:
        return F.trim(text).cast(to) if strict else F.trim(text).try_cast(to)

    if kind == "text":
        return text
    if kind == "number_text":
        return number_text(text)
    if kind == "bigint_text":
        return cast("bigint").cast("string")
    if kind == "timestamp":
        return timestamp(text, strict)
    if kind in ("int", "bigint"):
        return cast(kind)
    if kind.startswith("decimal"):
        return decimal_comma(text, kind, strict)
    raise ValueError(f"unknown kind {kind!r}")


def part(text: Column, index: int) -> Column:
    """Part 0 or 1 of a text divided by ``|``; null if there is no such part."""
    head = F.substring_index(text, "|", index + 1)
    if index == 0:
        return head
    return F.when(F.contains(text, F.lit("|")), F.substring_index(head, "|", -1))
