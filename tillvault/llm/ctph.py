"""Document fingerprints by context-triggered piecewise hashing (operator 9).

A hash of the last 7 bytes is taken at every byte of the UTF-8 text; where it is
block - 1 modulo the block size, a piece ends. Each piece gives one of 64 signs by
its CRC-32. The block size is 3 * 2^k, the least that makes a text of its length
about 64 pieces, and is halved while that gives under 32. A fingerprint is
``block:signs at the block size:signs at twice it``. Two fingerprints are compared
where block sizes are equal or one is twice the other, by 1 - edits / length of the
longer signature, and only if they share 7 signs in a row (a third of the signs of
shorter signatures).

``with_edits`` also fingerprints each document's text with its second half replaced
by the beginning of the next document by doc_id. Documents are dealt by ranges of
doc_id and read in order, so a text moves once; where a task's range ends, the next
range's first document is joined, two rows a task.

Defined results: a null or empty text has the fingerprint ``3::``, and equal
fingerprints have likeness 1; documents that share a doc_id follow each other by
their texts; null ids come first; the last document is followed by the first; a
single document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillvault.llm.common import id_and_text, task_base, written

WINDOW = 7
LEAST_BLOCK = 3
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH = 64
COMMON = 7
SEGMENT = 1 << 20  # bytes hashed at a time
_POWERS = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(WINDOW)]


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the 7 bytes that end at each byte from the seventh on."""
    wide = data.astype(np.uint32)
    wide += np.uint32(1)
    n = len(wide) - WINDOW + 1
    out = wide[:n] * _POWERS[WINDOW - 1]
    for k in range(1, WINDOW):
        out += wide[k : k + n] * _POWERS[WINDOW - 1 - k]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def ends_at(padded: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after which pieces end at ``block``, and those of them that end one at twice it too."""
    places, hashes = [], []
    for at in range(0, len(padded) - WINDOW + 1, SEGMENT):
        rolled = rolling(padded[at : at + SEGMENT + WINDOW - 1])
        found = np.flatnonzero(rolled % np.uint32(block) == block - 1)
        places.append(found + at + 1)
        hashes.append(rolled[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_places, rolled = np.concatenate(places), np.concatenate(hashes)
    return all_places, all_places[rolled % np.uint32(2 * block) == 2 * block - 1]


def signature(data: bytes, ends: np.ndarray, most: int = LENGTH) -> str:
    """A sign per piece; what follows the last end, or the last end that counts, is one piece."""
    signs, at = [], 0
    for end in ends[: most - 1].tolist():
        signs.append(SIGNS[zlib.crc32(data[at:end]) & 63])
        at = end
    if at < len(data):
        signs.append(SIGNS[zlib.crc32(data[at:]) & 63])
    return "".join(signs)


def fingerprint(text: str) -> str:
    data = text.encode()
    if not data:
        return f"{LEAST_BLOCK}::"
    padded = np.frombuffer(bytes(WINDOW - 1) + data, np.uint8)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        ends, twice = ends_at(padded, block)
        if len(ends) >= LENGTH // 2 - 1 or block == LEAST_BLOCK:
            return f"{block}:{signature(data, ends)}:{signature(data, twice, LENGTH // 2)}"
        block //= 2


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _alike(a: Column, b: Column) -> Column:
    """1 - edits / longer length, or 0 where no 7 signs in a row (a third of shorter ones) are shared."""
    run = F.least(F.lit(COMMON), F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / 3))).cast("int")

    def runs(s: Column) -> Column:
        last = F.greatest(F.length(s) - run + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(s, i, run))

    longer = F.greatest(F.length(a), F.length(b))
    near = 1 - F.levenshtein(a, b) / longer
    return F.when(a == b, 1.0).when(F.arrays_overlap(runs(a), runs(b)), near).otherwise(0.0)


def likeness(one: Column, other: Column) -> Column:
    """0 to 1 of two fingerprints."""
    a, b = F.split(one, ":"), F.split(other, ":")
    size_a, size_b = a[0].cast("long"), b[0].cast("long")
    same = F.greatest(_alike(a[1], b[1]), _alike(a[2], b[2]))
    return (
        F.when(one == other, 1.0)
        .when(size_a == size_b, same)
        .when(size_a == 2 * size_b, _alike(a[1], b[2]))
        .when(size_b == 2 * size_a, _alike(a[2], b[1]))
        .otherwise(0.0)
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_chars", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_EDGE = "task long, first_text string, last_id long, last_text string, first_fingerprint string, last_fingerprint string"
_NAMES = [part.split()[0] for part in f"{_ROW}, {_EDGE}".split(", ")]
_KINDS = [pa.int64() if part.split()[1] == "long" else pa.string() for part in f"{_ROW}, {_EDGE}".split(", ")]


def _result(doc_id, text: str, own: str, following: str, after: str) -> tuple:
    changed = edited(text, following)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        own,
        own if changed == text else fingerprint(changed),
        after,
    )


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order -> their results; the last waits for the next task: one row of edges."""
    first = last = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            now = (doc_id, text.as_py())
            now = (*now, last[2] if last and last[1] == now[1] else fingerprint(now[1]))
            if last is None:
                first = now
            else:
                rows.append((*_result(*last, now[1], now[2]), *[None] * 6))
            last = now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
    if last is not None:
        edge = (*[None] * 6, task_base(0), first[1], last[0], last[1], first[2], last[2])
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(edge, _KINDS)], _NAMES)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            _result(r["last_id"], r["last_text"], r["last_fingerprint"], r["next_text"], r["after"])
            for r in batch.to_pylist()
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES[:6])


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    texts = id_and_text(docs, id_col, text_col)
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(ordered.mapInArrow(_ordered, f"{_ROW}, {_EDGE}"), "edits")
    done, edges = rows.filter("task IS NULL"), rows.filter("task IS NOT NULL")
    # One narrow row a task: the number of the task that goes on.
    order = Window.partitionBy(F.lit(0)).orderBy("task")
    lowest = F.first("task").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = edges.select("task", F.coalesce(F.lead("task").over(order), lowest).alias("next_task"))
    heads = edges.select(
        F.col("task").alias("next_task"), F.col("first_text").alias("next_text"), F.col("first_fingerprint").alias("after")
    )
    pairs = edges.join(following, "task").join(heads, "next_task")
    ends = pairs.select("last_id", "last_text", "last_fingerprint", "next_text", "after").mapInArrow(_edges, _ROW)
    out = done.select(*_NAMES[:6]).unionByName(ends)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
