"""Repeated strings by difference-cover suffix buckets (operator 3).

Removes each byte of a text that lies in a string of ``SIZE`` bytes which also starts
anywhere else in the table. Texts are UTF-8; a string never crosses documents; what
counts is the input, not what is left.

1. Documents are put together in blocks of about a megabyte and written, compressed.
2. The suffixes at the places of a difference cover modulo V (a perfect difference
   set, so of any two places i and j there is a k < V with i + k and j + k both
   covered) are ranked by their first SIZE - V + 1 bytes: dealt to buckets and sorted
   one bucket at a time. What counts of a rank is whether another suffix shares it.
3. Two equal strings have a shared rank less than V bytes after their starts. So only
   suffixes that have one there can tie with another; all others are unique and never
   sorted. The suffixes in question are dealt to buckets by their first SIZE bytes, in
   PASSES passes that move one after the other, and again sorted one bucket at a time;
   ties are the repeated strings.
4. Their places go back to the blocks, where they are joined to runs and cut out.

A bucket holds a bounded number of suffixes: there are as many buckets as the table
needs. Within a segment of a block equal suffixes are one entry, so a string that
every document has is at most one entry a segment. Equal documents are found by their
digests and removed whole; only the first of them takes part in step 3.

Suffixes are sorted by 64-bit hashes of their bytes, and buckets are ranges of other
hashes: about one in 10^20 pairs of different strings of a bucket counts as a tie.

Defined results: a null or short text has nothing to remove; rows that repeat a text
of at least SIZE bytes, under the same id or not, lose it all; a null doc_id is kept;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import id_and_text, release, task_base, utf8, written
from tillvault.llm.shingles import mix

SIZE = 200
ORDER = 11  # the cover's: modulo 11^2 + 11 + 1 with 12 places
BLOCK = 1 << 20
SEGMENT = 1 << 20
PER_BUCKET = 1 << 21  # suffixes of a bucket, about
PASSES = 4  # over the suffixes in question: a quarter of the buckets moves at a time


def difference_cover(q: int) -> tuple[int, list[int]]:
    """(v, places): a perfect difference set modulo q^2 + q + 1 for a prime q, from powers in GF(q^3)."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # Powers of x modulo x^3 = a x^2 + b x + c; places are those without x^2.
                e, places = (1, 0, 0), []
                for i in range(v):
                    if e[2] == 0:
                        places.append(i)
                    e = (c * e[2] % q, (e[0] + b * e[2]) % q, (e[1] + a * e[2]) % q)
                if len(places) == q + 1 and len({(x - y) % v for x in places for y in places}) == v:
                    return v, places
    raise ValueError(f"no cover of order {q}")


class Hasher:
    """Hashes of the strings at given places of a segment, by one pass of prefix sums."""

    def __init__(self, size: int = SIZE, order: int = ORDER):
        self.size = size
        self.v, self.places = difference_cover(order)
        self.reach = size - self.v + 1
        rng = np.random.default_rng(31)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = 0xD1342543DE82EF95
        n = SEGMENT + size + 1
        self.power = np.full(n, base, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)

    def cover(self, ends: np.ndarray) -> np.ndarray:
        """The covered places of a block's documents that a string of ``size`` bytes can reach."""
        found = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= self.size:
                last = b - a - self.reach
                grid = (np.arange(0, last + 1, self.v)[:, None] + np.array(self.places)).ravel()
                found.append(grid[grid <= last] + a)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        return mix((sums[places + length] - sums[places]) * self.inverse[places])


class Block:
    """The documents of a block, and the entries of its segments."""

    def __init__(self, hasher: Hasher, data: bytes, ends: list[int], prints: list[bytes]):
        self.h, self.data = hasher, np.frombuffer(data, np.uint8)
        self.ends = np.array(ends, np.int64)
        self.names = np.array([int.from_bytes(p[:8], "little") for p in prints], np.uint64)

    def segments(self) -> Iterator[tuple[int, int, int]]:
        for number, a in enumerate(range(0, len(self.data), SEGMENT)):
            yield number, a, min(a + SEGMENT, len(self.data))

    def entries(
        self, places: np.ndarray, a: int, b: int, length: int, buckets: int = 1, only: int | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the places of a segment: (distinct hashes, who has them, the entry of each place).

        Who is a hash of (document's text, place in it), 0 where there are several.
        ``only``: the pass whose buckets count.
        """
        sums = self.h.sums(self.data[a : b + self.h.size])
        hashes = self.h.at(sums, places - a, length)
        if only is not None:
            mine = bucket_of(hashes, buckets) % np.uint64(PASSES) == only
            places, hashes = places[mine], hashes[mine]
        doc = np.searchsorted(self.ends, places, "right") - 1
        who = mix(self.names[doc] + (places - self.ends[doc]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        who |= np.uint64(1) << np.uint64(32) | np.uint64(1)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(fresh)
        entry = np.empty(len(places), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        if not len(first):
            return ordered, who, entry
        low, high = np.minimum.reduceat(who[order], first), np.maximum.reduceat(who[order], first)
        return ordered[first], np.where(low == high, low, np.uint64(0)), entry

    def covered(self, a: int, b: int, places: np.ndarray) -> np.ndarray:
        return places[np.searchsorted(places, a) : np.searchsorted(places, b)]

    def open_runs(self, ranked: np.ndarray, extra: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the suffixes that have a shared rank less than V bytes on, but for ``extra`` documents."""
        doc = np.searchsorted(self.ends, ranked, "right") - 1
        if extra:
            own = ~np.isin(doc, extra)
            doc, ranked = doc[own], ranked[own]
        low = np.maximum(ranked - self.h.v + 1, self.ends[doc])
        high = np.minimum(ranked + 1, self.ends[doc + 1] - self.h.size + 1)
        return joined(low[high > low], high[high > low])


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order of their starts, as ranges that neither meet nor touch."""
    if not len(low):
        return low, high
    reach = np.maximum.accumulate(high)
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return low[first], reach[np.append(first[1:] - 1, len(low) - 1)]


def spread(low: np.ndarray, high: np.ndarray, a: int, b: int) -> np.ndarray:
    """The numbers of the ranges that are in [a, b)."""
    low, high = np.clip(low, a, b), np.clip(high, a, b)
    sizes = high - low
    if not sizes.sum():
        return np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(starts - low, sizes)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hashes' upper halves."""
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes."""
    return np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))


_BLOCKS = "block long, ids array<long>, ends array<long>, prints array<binary>, data binary"
_OPEN = f"{_BLOCKS}, copies array<int>, low array<long>, high array<long>"
_DEALT = "bucket int, block long, segment int, entries binary"
_MARKS = "block long, segment int, bucket int, marks binary"


def _into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder, number, base = zstandard.ZstdCompressor(level=3), 0, task_base()
    ids: list = []
    texts: list[bytes] = []

    def row() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, texts)])
        prints = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([base + number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([ends], pa.list_(pa.int64())),
                pa.array([prints], pa.list_(pa.binary())),
                pa.array([coder.compress(b"".join(texts))], pa.binary()),
            ],
            ["block", "ids", "ends", "prints", "data"],
        )

    held = 0
    for batch in batches:
        for doc_id, view in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            ids.append(doc_id)
            texts.append(bytes(view))
            held += len(view)
            if held >= BLOCK:
                yield row()
                ids, texts, held, number = [], [], 0, number + 1
    if ids:
        yield row()


def _block(hasher: Hasher, row: dict) -> Block:
    size = row["ends"][-1]
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=size) if size else b""
    return Block(hasher, data, row["ends"], row["prints"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _dealt(block: int, segment: int, hashes: np.ndarray, who: np.ndarray, buckets: int, narrow: bool) -> pa.RecordBatch | None:
    """A segment's entries by bucket: their hashes, then who has them."""
    bounds = _bucket_bounds(hashes, buckets)
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
    if not rows:
        return None
    kind = np.uint32 if narrow else np.uint64
    left, right = hashes.astype(kind), (who >> np.uint64(32)).astype(kind) if narrow else who
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in rows], pa.int32()),
            pa.array([block] * len(rows), pa.int64()),
            pa.array([segment] * len(rows), pa.int32()),
            pa.array([left[a:b].tobytes() + right[a:b].tobytes() for _, a, b in rows], pa.binary()),
        ],
        ["bucket", "block", "segment", "entries"],
    )


def _sort_bucket(narrow: bool):
    """Sorts the suffixes of a bucket; a bit per entry says whether another suffix ties with it."""
    kind = np.uint32 if narrow else np.uint64

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(e.as_py(), kind) for e in table.column("entries")]
        sizes = [len(p) // 2 for p in parts]
        hashes = np.concatenate([p[:n] for p, n in zip(parts, sizes)])
        who = np.concatenate([p[n:] for p, n in zip(parts, sizes)])
        order = np.argsort(hashes, kind="stable")
        ordered, owners = hashes[order], who[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(fresh)
        low, high = np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)
        ties = np.empty(len(order), bool)
        ties[order] = np.repeat((low != high) | (low == 0), np.diff(np.append(first, len(order))))
        marks, at = [], 0
        for n in sizes:
            marks.append(np.packbits(ties[at : at + n]).tobytes())
            at += n
        return pa.table(
            [table.column("block"), table.column("segment"), table.column("bucket"), pa.array(marks, pa.binary())],
            ["block", "segment", "bucket", "marks"],
        )

    return run


def _marks_of(row: dict, column: str, segment: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a segment's entries."""
    out, bounds = np.zeros(len(hashes), bool), _bucket_bounds(hashes, buckets)
    for mark in row[column] or ():
        if mark["segment"] == segment:
            a, b = bounds[mark["bucket"]], bounds[mark["bucket"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(mark["marks"], np.uint8), count=b - a).astype(bool)
    return out


def _ranked_places(block: Block, row: dict, buckets: int) -> np.ndarray:
    cover, found = block.h.cover(block.ends), []
    for number, a, b in block.segments():
        places = block.covered(a, b, cover)
        hashes, _, entry = block.entries(places, a, b, block.h.reach)
        found.append(places[_marks_of(row, "ranks", number, hashes, buckets)[entry]])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _runs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.array(row["low"], np.int64), np.array(row["high"], np.int64)


def _spans(block: Block, row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the bytes to remove, in the block."""
    starts = []
    for number, a, b in block.segments():
        places = spread(*_runs(row), a, b)
        hashes, _, entry = block.entries(places, a, b, block.h.size)
        starts.append(places[_marks_of(row, "ties", number, hashes, buckets)[entry]])
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = begin + block.h.size
    if row["copies"]:
        docs = np.array(sorted(row["copies"]), np.int64)
        docs = docs[block.ends[docs + 1] - block.ends[docs] >= block.h.size]
        begin, end = np.append(begin, block.ends[docs]), np.append(end, block.ends[docs + 1])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    # Strings of different documents may touch and are not one run.
    doc = np.searchsorted(block.ends, begin, "right") - 1
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    return begin[first], reach[np.append(first[1:] - 1, len(begin) - 1)]


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; ``with_text`` adds the bytes left as ``kept``."""
    spark = docs.sparkSession
    blocks = written(id_and_text(docs, id_col, text_col).mapInArrow(_into_blocks, _BLOCKS), "blocks")
    total = blocks.agg(F.sum(F.element_at("ends", -1)).alias("n")).first().n or 0
    hasher: list[Hasher] = []

    def made() -> Hasher:
        if not hasher:
            hasher.append(Hasher())
        return hasher[0]

    rank_buckets = max(12, -(-total // (10 * PER_BUCKET)))
    buckets = max(12, -(-total // (4 * PER_BUCKET)))

    def deal_cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _block(made(), row)
            cover = block.h.cover(block.ends)
            for number, a, b in block.segments():
                hashes, who, _ = block.entries(block.covered(a, b, cover), a, b, block.h.reach)
                if (out := _dealt(row["block"], number, hashes, who, rank_buckets, True)) is not None:
                    yield out

    def to_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.int64(), longs, longs, pa.list_(pa.binary()), pa.binary(), ints, longs, longs]
        names = ["block", "ids", "ends", "prints", "data", "copies", "low", "high"]
        for row in _rows(batches):
            block = _block(made(), row)
            low, high = block.open_runs(_ranked_places(block, row, rank_buckets), row["extra"] or [])
            values = [row["block"], row["ids"], row["ends"], row["prints"], row["data"], row["copies"] or [], low, high]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def deal_open(only: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                block = _block(made(), row)
                for number, a, b in block.segments():
                    places = spread(*_runs(row), a, b)
                    hashes, who, _ = block.entries(places, a, b, block.h.size, buckets, only)
                    if (out := _dealt(row["block"], number, hashes, who, buckets, False)) is not None:
                        yield out

        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64()] * 4 + [pa.string(), span] + [pa.binary()] * with_text
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_text
        for row in _rows(batches):
            block = _block(made(), row)
            begin, end = _spans(block, row, buckets)
            data, rows = block.data.tobytes(), []
            for doc_id, a, b in zip(row["ids"], row["ends"], row["ends"][1:]):
                i, j = np.searchsorted(begin, a), np.searchsorted(begin, b)
                own = list(zip((begin[i:j] - a).tolist(), (end[i:j] - a).tolist())) if b > a else []
                edges = [0, *(x for pair in own for x in pair), b - a]
                kept = b"".join(data[a + x : a + y] for x, y in zip(edges[::2], edges[1::2]))
                out = [doc_id, b - a, b - a - len(kept), len(own), hashlib.sha256(kept).hexdigest()]
                out.append([{"start": x, "end": y} for x, y in own])
                rows.append(out + [kept] * with_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def sorted_marks(dealt: DataFrame, narrow: bool) -> DataFrame:
        return written(dealt.groupBy("bucket").applyInArrow(_sort_bucket(narrow), _MARKS), "marks")

    def by_block(marks: DataFrame, name: str) -> DataFrame:
        # As many rows for a block as it has segments and buckets.
        return marks.groupBy("block").agg(F.collect_list(F.struct("segment", "bucket", "marks")).alias(name))

    ranks = sorted_marks(blocks.mapInArrow(deal_cover, _DEALT), True)
    release(spark)
    found = blocks.join(by_block(ranks, "ranks"), "block", "left").join(copies_of(blocks), "block", "left")
    opened = written(found.mapInArrow(to_open, _OPEN), "open")
    release(spark)
    ties = []
    for only in range(PASSES):
        ties.append(sorted_marks(opened.filter(F.size("low") > 0).mapInArrow(deal_open(only), _DEALT), False))
        release(spark)
    whole = opened.join(by_block(reduce(DataFrame.unionByName, ties), "ties"), "block", "left")
    return whole.mapInArrow(cut, _OUT + ", kept binary" * with_text)


def copies_of(blocks: DataFrame) -> DataFrame:
    """(block, copies, extra): the documents whose text another has, and those of them that are not the first."""
    prints = blocks.select("block", F.posexplode("prints").alias("doc", "print"))
    place = F.struct("block", "doc")
    several = prints.groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    later = F.when(place != F.col("first"), F.col("doc"))
    return (
        prints.join(several, "print")
        .groupBy("block")
        .agg(F.collect_list("doc").alias("copies"), F.collect_list(later).alias("extra"))
    )
