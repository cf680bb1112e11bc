"""Export files as DataFrames.

Files are read as text by header name, then typed. The cp1252 exports are read
as ISO-8859-1, which every Spark installation accepts, and repaired with a
built-in expression, so no session setting and no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillvault.functions import german
from tillvault.schemas import EXPORTS

# Field texts that stand for "no value".
NULL_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Lines of one split that make up one block of the file order (see operators.ordering).
BLOCK_LINES = 20  # as a power of two


#: Columns of a reading that sets bad lines aside: what is wrong, and the line itself.
FAULTS, LINE, FILE = "_fehler", "_text", "_pfad"
_CORRUPT = "_corrupt_record"


def read_export(
    spark: SparkSession,
    name: str,
    paths: str | Sequence[str],
    null_texts: Sequence[str] = NULL_TEXTS,
    file_order: bool = False,
    strict: bool = True,
) -> DataFrame:
    """One or many files of an export, typed, columns under their table names.

    All files of a call must have the same header; a file with another one is
    an error, as is a required column that is missing. With ``file_order`` the
    result also has the columns that reproduce the order of lines: ``_datei``,
    ``_block`` (a coarse place in the file) and ``_zeile`` (a fine one).

    A line with too few or too many fields, or with a field that is not of its kind,
    stops the reading. Not ``strict``: it stays, and ``_fehler`` says what is wrong
    (see ``split_lines``).
    """
    spec = EXPORTS[name]
    cp1252 = spec.encoding == "cp1252"
    files = [paths] if isinstance(paths, str) else list(paths)
    reader = (
        spark.read.option("sep", ";")
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("encoding", "ISO-8859-1" if cp1252 else spec.encoding)
    )
    if strict:
        raw = reader.option("mode", "FAILFAST").csv(files)
    else:
        headers = reader.csv(files).columns
        fields = ", ".join(f"`{h}` string" for h in [*headers, _CORRUPT])
        raw = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).schema(fields).csv(files)
    columns = []
    if file_order:
        line = F.monotonically_increasing_id()
        start = F.col("_metadata.file_block_start")
        columns = [
            F.col("_metadata.file_path").alias("_datei"),
            F.struct(start.alias("start"), F.shiftright(line, BLOCK_LINES).alias("teil")).alias("_block"),
            line.alias("_zeile"),
        ]
    if not strict:
        text = F.coalesce(_CORRUPT, F.concat_ws(";", *(F.coalesce(f"`{h}`", F.lit("")) for h in headers)))
        text = german.repair_cp1252(text) if cp1252 else text
        columns += [F.col("_metadata.file_path").alias(FILE), text.alias(LINE)]
    return typed(raw, name, null_texts, columns, strict)


def typed(
    raw: DataFrame, name: str, null_texts: Sequence[str] = NULL_TEXTS, extra: Sequence[Column] = (), strict: bool = True
) -> DataFrame:
    """Lines of texts under an export's headers -> typed columns under their table names.

    The texts of a cp1252 export are as ISO-8859-1 reads them. Not ``strict``: a field
    that is not of its kind is null, and its column's name is among the line's ``_fehler``.
    """
    spec = EXPORTS[name]
    cp1252 = spec.encoding == "cp1252"
    missing = [header for header in spec.columns if header not in raw.columns]
    if missing:
        raise ValueError(f"{name}: the file has no column {', '.join(missing)}")

    columns, faults = [], []
    if not strict and _CORRUPT in raw.columns:
        faults.append(F.when(F.col(_CORRUPT).isNotNull(), F.lit("zeile")))
    for header, (column, kind) in spec.columns.items():
        text = F.col(f"`{header}`")
        if cp1252:
            text = german.repair_cp1252(text)
        text = F.when(~text.isin(*null_texts), text)
        value = german.parse(text, kind, strict)
        columns.append(value.alias(column))
        if kind not in ("text", "number_text"):
            faults.append(F.when(text.isNotNull() & value.isNull(), F.lit(column)))
    if not strict:
        found = F.array_compact(F.array(*faults)) if faults else F.array().cast("array<string>")
        rows = raw.select(*columns, *extra, found.alias(FAULTS))
        # One list a line, and its own row: a filter by faults then reads the list, where it
        # would otherwise take its place and parse each field again, several times over.
        return rows.withColumn(FAULTS, F.explode(F.array(FAULTS)))
    rows = raw.select(*columns, *extra)
    return rows.dropDuplicates() if spec.distinct else rows


def split_lines(lines: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A reading that is not strict -> (good rows as a strict one gives them, bad lines with their ``_fehler``)."""
    bad = F.size(FAULTS) > 0
    good = lines.filter(~bad).drop(FAULTS, LINE, FILE)
    return good.dropDuplicates() if EXPORTS[name].distinct else good, lines.filter(bad)
