"""File-drop ingestion: files put under ``<root>/<export>/<date>/`` are imported.

A file stream finds them; its checkpoint remembers which it has seen. The rows of
each micro-batch, one per file, are written as a partition of the table of arrivals
beside the checkpoint, so that a batch that is run again writes the same partition.
What has arrived and is not in the table of loaded files (an anti-join) is pending
and imported by export date, because the satellites depend on the order of exports.
A load and its rows in the table of files are published together.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from itertools import groupby

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillvault.plans.jobs import LOADED, SET_ASIDE, file_rows, run_import
from tillvault.plans.store import Store
from tillvault.schemas import EXPORTS

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_ARRIVALS = "export string, export_datum date, pfad string, zeit timestamp_ntz"

ON_BAD = ("raise", "set_aside")


class LateFile(ValueError):
    """A file is older than one of its export that is loaded already."""


class UnknownPlace(ValueError):
    """A file lies under no known export or under no date."""


def located(files: DataFrame) -> DataFrame:
    """(path, modificationTime) -> (export, export_datum, pfad, zeit); null where the place tells neither."""
    parts = F.split("path", "/")
    export = F.element_at(parts, -3)
    day = F.try_to_timestamp(F.element_at(parts, -2), F.lit("dd.MM.yyyy"))
    return files.select(
        F.when(export.isin(*EXPORTS), export).alias("export"),
        day.cast("date").alias("export_datum"),
        F.col("path").alias("pfad"),
        F.col("modificationTime").cast("timestamp_ntz").alias("zeit"),
    )


def pending(store: Store, arrivals: DataFrame) -> DataFrame:
    """What has arrived and is not known to the store, with the newest loaded date of its export (``neueste``)."""
    files = store.read("dateien_t")
    newest = files.filter(F.col("stand") == LOADED).groupBy("export").agg(F.max("export_datum").alias("neueste"))
    fresh = arrivals.groupBy("export", "export_datum", "pfad").agg(F.max("zeit").alias("zeit"))
    fresh = fresh.join(files.select("pfad"), "pfad", "left_anti")
    return fresh.join(newest, "export", "left")


def _groups(rows: Iterator[Row]) -> Iterator[tuple[str, date, list[Row]]]:
    """Master files singly, the journal files of a date together, which gives the same rows as one by one."""
    for (day, export), found in groupby(rows, key=lambda r: (r.export_datum, r.export)):
        if export == "journal":
            yield export, day, list(found)
        else:
            yield from ((export, day, [row]) for row in found)


def _load(store: Store, export: str, day: date, files: list[Row]) -> None:
    # The newest file's time stands for the load, so a repeated load gives the same rows.
    time: datetime = max(row.zeit for row in files).replace(microsecond=0)
    paths = [row.pfad for row in files]
    run_import(store.spark, store, export, paths, day, time, files=file_rows(store.spark, export, day, paths, time))


def _set_aside(store: Store, row: Row, reason: str) -> None:
    load = store.begin()
    load.append("dateien_t", file_rows(store.spark, row.export, row.export_datum, [row.pfad], row.zeit, SET_ASIDE, reason[:500]))
    load.commit()


def import_pending(store: Store, files: DataFrame, on_late: str = "raise", on_bad: str = "raise") -> int:
    """Imports what is not loaded yet of ``files`` (path, modificationTime); gives the number of loads.

    Files older than what is loaded of their export cannot be loaded any more, as the
    history depends on the order of dates: they are refused (``on_late='raise'``) or
    passed over (``'skip'``). With ``on_bad='set_aside'`` a file that cannot be loaded,
    or lies in no known place, is entered in the table of files with the reason, and
    the others go on; else it stops the import, and what was loaded before stays.
    """
    if on_bad not in ON_BAD:
        raise ValueError(f"on_bad must be one of {ON_BAD}")
    return _import(store, located(files), on_late, on_bad)


def _import(store: Store, arrivals: DataFrame, on_late: str, on_bad: str) -> int:
    loads = 0
    rows = pending(store, arrivals).orderBy("export_datum", "export", "pfad").toLocalIterator()
    for export, day, found in _groups(_wanted(store, rows, on_late, on_bad)):
        try:
            _load(store, export, day, found)
            loads += 1
        except (ValueError, PySparkException, Py4JJavaError) as error:
            if on_bad == "raise":
                raise
            for row in found:
                if len(found) > 1:
                    loads += _one(store, export, day, row)
                else:
                    _set_aside(store, row, f"{type(error).__name__}: {error}")
    return loads


def _wanted(store: Store, rows: Iterator[Row], on_late: str, on_bad: str) -> Iterator[Row]:
    for row in rows:
        if row.export is None or row.export_datum is None:
            if on_bad == "raise":
                raise UnknownPlace(f"{row.pfad}: not under <export>/<dd.mm.yyyy>/")
            _set_aside(store, row, "place")
        elif row.neueste is not None and row.export_datum < row.neueste:
            if on_late == "raise":
                raise LateFile(f"{row.pfad}: {row.export} is loaded up to {row.neueste} already")
        else:
            yield row


def _one(store: Store, export: str, day: date, row: Row) -> int:
    try:
        _load(store, export, day, [row])
        return 1
    except (ValueError, PySparkException, Py4JJavaError) as error:
        _set_aside(store, row, f"{type(error).__name__}: {error}")
        return 0


# --- streams --------------------------------------------------------------------------


def _stream(spark: SparkSession, root: str, max_files: int | None) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.csv")
    if max_files:
        found = found.option("maxFilesPerTrigger", max_files)
    # The content is never read here.
    return found.option("recursiveFileLookup", True).load(root).select("path", "modificationTime")


def _arrive(files: DataFrame, batch_id: int, checkpoint: str) -> None:
    located(files).write.mode("overwrite").parquet(f"{checkpoint}/arrivals/batch={batch_id}")


def arrived(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table of arrivals."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/arrivals")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _ARRIVALS)
    return spark.read.schema(_ARRIVALS).parquet(f"{checkpoint}/arrivals").select("export", "export_datum", "pfad", "zeit")


def run_filedrop(
    spark: SparkSession,
    store: Store,
    root: str,
    checkpoint: str,
    max_files: int | None = 1000,
    on_late: str = "raise",
    on_bad: str = "raise",
) -> int:
    """Takes in all files that are there now, then imports what is pending; gives the number of loads.

    ``max_files`` bounds a micro-batch, which only enters arrivals: neither it nor the
    order of arrival changes the tables. A run that stopped goes on where it was.
    """
    writer = _stream(spark, root, max_files).writeStream.foreachBatch(lambda df, batch: _arrive(df, batch, checkpoint))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _import(store, arrived(spark, checkpoint), on_late, on_bad)


def start_filedrop(
    spark: SparkSession,
    store: Store,
    root: str,
    checkpoint: str,
    interval: str = "1 minute",
    on_late: str = "raise",
    on_bad: str = "raise",
) -> StreamingQuery:
    """Goes on looking for files; each micro-batch holds all new ones and imports what is pending."""

    def batch(df: DataFrame, batch_id: int) -> None:
        _arrive(df, batch_id, checkpoint)
        _import(store, arrived(spark, checkpoint), on_late, on_bad)

    writer = _stream(spark, root, None).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()
