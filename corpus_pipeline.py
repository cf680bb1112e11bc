"""The corpus pipeline: documents -> packed training sequences, in five stages.

Each stage reads all that the one before it kept, from a written table. A row is
known by its doc_id and text, whatever other columns the table has; all columns are
handed on.

language    drops documents that language identification rejects: no letter in the
            text, or farther from every language than its own documents are
exact       of equal texts the one with the largest doc_id stays; of rows that repeat
            a doc_id and its text the one whose columns, as JSON, have the least SHA-256
near        of near duplicates (five-word shingles, similarity 0.75) the one with the
            smallest doc_id stays (null last, then by md5 of the text)
mix         a share of the tokens stays, drawn so that sources, languages and forms
            come closer to their targets; each document goes on once at most, so where a
            cell is due more copies the targets are not reached
pack        the pieces of the packed sequences

Null values in any column, empty texts and empty tables pass through every stage:
only the first drops texts without a letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillvault.llm import exact, langid, minhash, mixing, packing
from tillvault.llm.common import tune, written


def _without(docs: DataFrame, gone: DataFrame, digest: Callable) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest of the text) is not in ``gone`` (id, digest)."""
    rows = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        docs["doc_id"].cast("long").alias("own_id"),
        digest(F.coalesce(docs["text"], F.lit(""))).alias("own_digest"),
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
    return rows.join(gone, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    model = langid.fit(langid.learnable(docs))
    found = langid.predict(docs, model).filter("NOT rejected")
    return found.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    groups = written(exact.exact_groups(docs), "groups")
    key = [F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")]
    rows = _without(docs, groups.filter("NOT kept").select(*key), lambda text: F.sha2(text, 256))
    again = groups.filter("kept AND group_size > 1").groupBy(*key).count().filter("count > 1").select("id", "digest")
    if not again.isEmpty():
        # Rows that repeat an id and a text: the one whose columns have the least digest stays.
        same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest"))
        place = F.sha2(F.to_json("row"), 256)
        one = rows.join(again, same, "left_semi").groupBy("own_id", "own_digest").agg(F.min_by("row", place).alias("row"))
        rows = rows.join(again, same, "left_anti").unionByName(one)
    return rows.select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    gone = minhash.near_groups(docs).filter("NOT stays")
    gone = gone.select(F.col("doc_id").alias("id"), F.col("text_md5").alias("digest"))
    return _without(docs, gone, F.md5).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs).filter("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("exact", exact_stage), ("near", near), ("mix", mix), ("pack", pack)]

# Nearest centroids, sketches, raking and packing are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
