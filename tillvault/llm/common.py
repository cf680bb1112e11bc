"""Helpers shared by the text operators: shared folders, Arrow access to texts, fixed hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators count on; all at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary one on one machine, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tillvault-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str, **options: str | int) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def records_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile hands Python at most so many rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, whatever else the table has."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *more
    )


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` on each Arrow batch; None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text without copying; null counts as empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return []
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(at, at[1:])]


def task_base(bits: int = 40) -> int:
    """First number of this task's own range of numbers."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << bits


def learns(doc_id: Column, folds: int = 3, held_out: int = 1) -> Column:
    """False for the rows whose label must not be learned. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out, F.lit(False))


def learns_id(doc_id: int | None, folds: int = 3, held_out: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds != held_out


def same_hash(column: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    # md5 is the one hash that every SQL engine has.
    digest = F.md5(F.concat_ws(":", column.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
