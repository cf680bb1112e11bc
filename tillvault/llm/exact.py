"""Exact duplicates by composable polynomial fingerprints (operator 2).

The fingerprint of bytes b0..bn-1 is sum(b_i * B^(n-1-i)) modulo two primes, with
the length. Those of neighbouring chunks combine: h(xy) = h(x) * B^|y| + h(y). So a
huge document is cut into segments that are hashed in parallel, on any executor,
and combined in order; a document up to ``HUGE`` bytes is hashed where it is read.

1. One pass counts the documents of each fingerprint (narrow rows, summed before
   the shuffle). The fingerprints that occur more than once mark a bitmap of fixed
   size; its false marks only cost work.
2. A second pass lets marked documents through, and compares each with the first
   of its fingerprint in the task, chunk by chunk. Only those first ones ("leaders")
   carry their text on: of a group of any size at most a few a task.
3. The leaders' chunks are compared with those of one leader of the fingerprint. A
   document that differs (a collision) is told apart by its SHA-256.

Defined results: null text counts as empty; the row with the largest doc_id of a
group stays; null ids rank lowest; rows that repeat a doc_id and its text stay or
go together, and each counts in ``group_size``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import id_and_text, map_batches, utf8, written

PRIMES = (2147483629, 2147483587)
BASES = (1003162753, 1582840423)
BLOCK = 1 << 14  # 255 * 2^31 * 2^14 < 2^53: a block's sum is exact in doubles
CHUNK = 1 << 16  # bytes compared at a time
SEGMENT = 1 << 20
HUGE = 1 << 22
BITMAP_BITS = 25  # 4 MB, whatever the size of the input
LEADER_BYTES = 1 << 25  # texts of leaders a task remembers

FINGERPRINT = "n_bytes long, h1 long, h2 long"


def _powers() -> np.ndarray:
    table = np.ones((BLOCK + 1, 2), np.uint64)
    for i in range(1, BLOCK + 1):
        table[i] = [int(table[i - 1, k]) * BASES[k] % PRIMES[k] for k in (0, 1)]
    return table


class Polynomial:
    """Fingerprints of bytes, and how they combine."""

    def __init__(self):
        powers = _powers()
        self.down = powers[BLOCK - 1 :: -1].astype(np.float64)
        self.shift = [tuple(map(int, row)) for row in powers]

    def block(self, data: np.ndarray) -> tuple[int, int]:
        sums = data.astype(np.float64) @ self.down[BLOCK - len(data) :]
        return int(sums[0]) % PRIMES[0], int(sums[1]) % PRIMES[1]

    def of(self, data: memoryview) -> tuple[int, int]:
        h1 = h2 = 0
        whole = np.frombuffer(data, np.uint8)
        for at in range(0, len(whole), BLOCK):
            part = whole[at : at + BLOCK]
            (a, b), (s1, s2) = self.block(part), self.shift[len(part)]
            h1, h2 = (h1 * s1 + a) % PRIMES[0], (h2 * s2 + b) % PRIMES[1]
        return h1, h2


def _column(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, kind)


def hash_segments(df: DataFrame) -> DataFrame:
    """(tag, part, bytes) -> (tag, part, n_bytes, h1, h2, s1, s2); s: the base to the power of the length."""
    made: list[Polynomial] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Polynomial())
        views = utf8(batch.column(2))
        hashes = [made[0].of(v) for v in views]
        values = [
            batch.column(0),
            batch.column(1),
            _column([len(v) for v in views], pa.int64()),
            *(_column([h[k] for h in hashes], pa.int64()) for k in (0, 1)),
            *(_column([pow(BASES[k], len(v), PRIMES[k]) for v in views], pa.int64()) for k in (0, 1)),
        ]
        return pa.RecordBatch.from_arrays(values, ["tag", "part", "n_bytes", "h1", "h2", "s1", "s2"])

    return map_batches(df, run, f"tag string, part int, {FINGERPRINT}, s1 long, s2 long")


def combine(parts: Column) -> Column:
    """Fingerprints of consecutive parts (part, n_bytes, h1, h2, s1, s2) -> that of the whole."""
    start = F.struct(F.lit(0).cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(h) for h in ("h1", "h2")))

    def step(whole: Column, part: Column) -> Column:
        return F.struct(
            (whole.n_bytes + part.n_bytes).alias("n_bytes"),
            *(
                ((whole[f"h{k + 1}"] * part[f"s{k + 1}"] + part[f"h{k + 1}"]) % PRIMES[k]).alias(f"h{k + 1}")
                for k in (0, 1)
            ),
        )

    return F.aggregate(F.sort_array(parts), start, step)


def fingerprints(docs: DataFrame, huge: int = HUGE, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, h1, h2)."""
    made: list[Polynomial] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Polynomial())
        views = utf8(batch.column(1))
        hashes = [made[0].of(v) for v in views]
        values = [batch.column(0), _column([len(v) for v in views], pa.int64())]
        values += [_column([h[k] for h in hashes], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(values, ["doc_id", "n_bytes", "h1", "h2"])

    size = F.octet_length("text")
    small = map_batches(docs.filter(size <= huge), run, f"doc_id long, {FINGERPRINT}")
    # The text's own hash tells rows apart that share an id.
    large = docs.filter(size > huge).select(
        F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"),
        F.encode("text", "UTF-8").alias("bytes"),
    )
    parts = large.select(
        F.to_json("key").alias("tag"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), ((F.octet_length("bytes") - 1) / segment).cast("int")),
                lambda i: F.substr("bytes", i * segment + 1, F.lit(segment)),
            )
        ).alias("part", "bytes"),
    ).repartition("tag", "part")
    joined = hash_segments(parts).groupBy("tag").agg(
        combine(F.collect_list(F.struct("part", "n_bytes", "h1", "h2", "s1", "s2"))).alias("whole")
    )
    return small.unionByName(
        joined.select(F.get_json_object("tag", "$.doc_id").cast("long").alias("doc_id"), "whole.*")
    )


def slot(print_: tuple, bits: int):
    """The place of a fingerprint in the bitmap; of columns or of numbers."""
    n, h1, h2 = print_
    return (h1 * 1000003 + h2 * 31 + n) % (1 << bits)


def repeated_slots(counts: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the fingerprints that occur more than once: at most 2^bits bits in all."""
    place = slot(tuple(map(F.col, PRINT)), bits) + 1  # positions count from 1
    slots = counts.filter("rows > 1").select(place.alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )


def same_bytes(a: memoryview, b: memoryview, chunk: int = CHUNK) -> bool:
    return len(a) == len(b) and all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))


def is_marked(place: int, bitmap: dict[int, bytes]) -> bool:
    # Buckets count from 1 and hold 32,768 bits, the lowest of a byte first.
    bits = bitmap.get(place // 32768 + 1)
    return bool(bits and bits[place % 32768 >> 3] >> (place & 7) & 1)


def told_apart(docs: DataFrame, bitmap: dict[int, bytes], bits: int) -> DataFrame:
    """Second pass: every document with its SHA-256; marked ones with their leader, leaders with their text."""
    made: list[Polynomial] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[tuple[str, bytes]]] = {}
        held = 0
        if not made:
            made.append(Polynomial())
        for batch in batches:
            views = utf8(batch.column(1))
            prints, shas, leaders, texts = [], [], [], []
            for view in views:
                mine, sha, leader, text = (len(view), *made[0].of(view)), hashlib.sha256(view).hexdigest(), None, None
                if is_marked(slot(mine, bits), bitmap):
                    leader = next((s for s, t in known.get(mine, ()) if same_bytes(memoryview(t), view)), None)
                    if leader is None:
                        leader, text = sha, bytes(view)
                        if held > LEADER_BYTES:
                            known.clear()
                            held = 0
                        known.setdefault(mine, []).append((sha, text))
                        held += len(text) + 200
                prints.append(mine)
                shas.append(sha)
                leaders.append(leader)
                texts.append(text)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = (*(zip(*prints) if prints else ((), (), ())), shas, leaders, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(_column(list(c), k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_bytes", "h1", "h2", "sha", "leader", "text"],
            )

    return docs.mapInArrow(run, f"doc_id long, {FINGERPRINT}, sha string, leader string, text binary")


PRINT = ["n_bytes", "h1", "h2"]


def variants(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(n_bytes, h1, h2, leader, variant): empty for the texts that equal the fingerprint's first leader."""
    leaders = rows.filter("text IS NOT NULL").select(*PRINT, "leader", "text").dropDuplicates([*PRINT, "leader"])
    chunks = leaders.select(
        *PRINT,
        "leader",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), (F.greatest(F.octet_length("text") - 1, F.lit(0)) / chunk).cast("int")),
                lambda i: F.substr("text", i * chunk + 1, F.lit(chunk)),
            )
        ).alias("part", "bytes"),
    )
    first = leaders.groupBy(*PRINT).agg(F.min("leader").alias("leader"))
    model = chunks.join(first, [*PRINT, "leader"], "left_semi").select(*PRINT, "part", F.col("bytes").alias("model"))
    compared = chunks.join(model, [*PRINT, "part"])
    return compared.groupBy(*PRINT, "leader").agg(
        F.when(F.bool_and(F.col("bytes") == F.col("model")), "").otherwise(F.col("leader")).alias("variant")
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """The second pass's rows with the row that stays and the size of their group."""
    single = rows.filter("leader IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    marked = rows.filter("leader IS NOT NULL").select("doc_id", *PRINT, "leader", "sha")
    # Summed per leader first, so a group that holds much of the table is a few rows here.
    sums = marked.groupBy(*PRINT, "leader").agg(F.max("doc_id").alias("top"), F.count("*").alias("rows"))
    texts = sums.join(variants(rows), [*PRINT, "leader"])
    groups = texts.groupBy(*PRINT, "variant").agg(
        F.max("top").alias("keep_id"), F.sum("rows").alias("group_size"), F.collect_set("leader").alias("leaders")
    )
    found = groups.select(*PRINT, F.explode("leaders").alias("leader"), "keep_id", "group_size")
    # Leaders are named by SHA-256 and told apart byte by byte: equal texts of other tasks share the name.
    joined = marked.join(found, [*PRINT, "leader"]).select("doc_id", "keep_id", "group_size", "sha")
    return single.unionByName(joined).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITMAP_BITS, huge: int = HUGE
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    texts = id_and_text(docs, id_col, text_col)
    counts = fingerprints(texts, huge).groupBy(*PRINT).agg(F.count("*").alias("rows"))
    bitmap = {row.bucket: bytes(row.bits) for row in repeated_slots(counts, bits).collect()}
    # Hashing again is cheaper than moving every text.
    return groups_of(written(told_apart(texts, bitmap, bits), "exact"))
