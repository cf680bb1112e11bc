"""Phrase collocations from full-text indexes of word numbers (operator 13).

Texts of one language are gathered in shards of about ``SHARD_WORDS`` words, where they
are read. A shard is a text of word numbers with 0 between pieces (a piece ends at
``[.,;:!?]`` or a line break), indexed both ways: the Burrows-Wheeler transform of the
text and that of the text reversed, each sorted by as many words as phrases can have.
A phrase is a pair of intervals of rows, one in each index, of equal length, which is
its count. Extending it to the left looks at the words that the forward index holds in
its interval: each different word c is a longer phrase, whose forward interval begins at
the row that c's first row maps to, and whose backward interval begins as much later as
there are smaller words. Extending to the right is the same with the indexes exchanged.
The phrases of a shard are extended in numpy, so many at once that their intervals hold
about ``PART_ROWS`` rows.

A shard is a few MB: it is written as a row group and read as an Arrow batch of its own, so
what a task holds depends on the size of a shard and not on how many shards it reads.

Depth goes up one level at a time over all shards. The phrases of a level are summed
over the shards and those found often enough, F(d), are kept; a phrase of d + 1 words can
only be among F(d + 1) if both its parts of d words are in F(d). A bitmap of fixed size
marks F(d), so that most phrases are not extended; its false marks cost work, no results.

The scores come from joins of the summed phrases, which are few. Whether a phrase is
part of a longer one with nearly its count shows in its longest extensions by one word.

Defined results: null text counts as empty, null lang as ``und``; texts without words
add nothing; rows that repeat count each; other columns are ignored; an empty table
gives no rows. A piece longer than a shard is cut with an overlap, and what the overlap
holds is counted off again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillvault.llm.common import records_a_batch, utf8, written

LONGEST = 4
LEAST_COUNT = 30
PART_OF = 80  # percent of its count that makes a phrase part of a longer one
TOP = 2000
SHARD_WORDS = 1 << 19
PART_ROWS = 1 << 17
BITMAP_BITS = 25

_END = b"\xff"  # in no UTF-8 text
_PLAIN = bytes(
    _END[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
SLICE = 1 << 20


# --- one shard ----------------------------------------------------------------------


def word_ids(data: bytes, number: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers from ``number``; 0 where a piece ends, once, and at the end."""
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = data[at:end].translate(_PLAIN).replace(_END, b" \xff ").split()
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        at = end
    ids = np.concatenate([*parts, np.zeros(1, np.int32)])
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    return ids[keep] if len(ids) > 1 else ids[:0]


def numbers() -> dict[bytes, int]:
    number: dict[bytes, int] = defaultdict(count().__next__)
    number[_END]
    return number


def transform(text: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of a cyclic text, its rows sorted by their first ``LONGEST`` symbols."""
    rank, known = text.astype(np.int64), 1
    while known < LONGEST:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -known)
        known *= 2
        if known < LONGEST:
            rank = np.unique(key, return_inverse=True)[1]
    return text[np.argsort(key) - 1]


class Index:
    """Rows of one direction: which symbol precedes each, and the row that begins with it."""

    def __init__(self, transformed: np.ndarray, symbols: int):
        self.symbol, self.symbols = transformed, symbols
        self.first = np.concatenate([[0], np.cumsum(np.bincount(transformed, minlength=symbols))]).astype(np.int32)
        self._to: np.ndarray | None = None

    @property
    def to(self) -> np.ndarray:
        if self._to is None:
            self._to = np.empty(len(self.symbol), np.int32)
            self._to[np.argsort(self.symbol, kind="stable")] = np.arange(len(self.symbol))
        return self._to


class Phrases:
    """Phrases of one length: their words, and their intervals [start, start + size) in both indexes."""

    def __init__(self, words: list[np.ndarray], forward: np.ndarray, backward: np.ndarray, size: np.ndarray):
        self.words, self.forward, self.backward, self.size = words, forward, backward, size

    def only(self, keep: np.ndarray | slice) -> Phrases:
        return Phrases([w[keep] for w in self.words], self.forward[keep], self.backward[keep], self.size[keep])

    def parts(self, rows: int) -> Iterator[Phrases]:
        """One or more parts, in order, whose intervals have about ``rows`` rows, or one phrase with more."""
        ends = np.cumsum(self.size)
        inner = np.searchsorted(ends, np.arange(rows, ends[-1], rows)) if len(ends) else []
        bounds = np.unique([0, *inner, len(ends)])
        for a, b in zip(bounds[:-1], bounds[1:]) if len(ends) else [(0, 0)]:
            yield self.only(slice(a, b))


def together(parts: list[Phrases]) -> Phrases:
    words, *others = zip(*((p.words, p.forward, p.backward, p.size) for p in parts))
    return Phrases([np.concatenate(w) for w in zip(*words)], *map(np.concatenate, others))


class Shard:
    def __init__(self, forward: np.ndarray, backward: np.ndarray, words: int):
        self.forward, self.backward, self.symbols = Index(forward, words + 1), Index(backward, words + 1), words + 1

    def single(self) -> Phrases:
        first = self.forward.first
        return Phrases([np.arange(1, self.symbols, dtype=np.int32)], first[1:-1], first[1:-1], np.diff(first)[1:])

    def extended(self, phrases: Phrases, left: bool, last: bool = False) -> Phrases:
        """Every phrase with one more word on its left or right, and how often; ``last``: without the intervals."""
        return together([*self.extensions(phrases, left, last)])

    def extensions(self, phrases: Phrases, left: bool, last: bool = False, rows: int = PART_ROWS) -> Iterator[Phrases]:
        """The same in parts, of which only one is worked on at a time."""
        for part in phrases.parts(rows):
            yield self._extended(part, left, last)

    def _extended(self, phrases: Phrases, left: bool, last: bool) -> Phrases:
        index, start, other = (
            (self.forward, phrases.forward, phrases.backward) if left else (self.backward, phrases.backward, phrases.forward)
        )
        ends = np.cumsum(phrases.size)
        begins = ends - phrases.size
        rows = np.repeat(start - begins, phrases.size)
        rows += np.arange(len(rows))
        key = np.repeat(np.arange(len(ends)) * self.symbols, phrases.size)
        key += index.symbol[rows]
        if last:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.diff(np.append(at, len(key))).astype(np.int32)
        of, symbol = np.divmod(key[at], self.symbols)
        symbol = symbol.astype(np.int32)
        words = [w[of] for w in phrases.words]
        words = [symbol, *words] if left else [*words, symbol]
        near = far = counts
        if not last:
            near = index.to[rows[order[at]]]
            far = (other[of] + at - begins[of]).astype(np.int32)  # as many rows later as there are smaller symbols
        found = Phrases(words, near if left else far, far if left else near, counts)
        return found.only(symbol != 0)


# --- marks of the phrases that go on --------------------------------------------------


def _slot(lang: Column, words: list[Column], bits: int) -> Column:
    value = F.shiftrightunsigned(F.xxhash64(lang), 39)
    for k, word in enumerate(words):
        value = value.bitwiseXOR(F.shiftrightunsigned(F.xxhash64(word), 13 * k))
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)  # the hash and seed of the built-in function


class Marks:
    def __init__(self, bitmap: np.ndarray, bits: int):
        self.bitmap, self.bits = bitmap, bits

    def has(self, lang: str, hashes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        value = np.uint64(_word_hash(lang.encode()) >> 39)
        for k, word in enumerate(words):
            value = value ^ (hashes[word] >> np.uint64(13 * k))
        slot = (value & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def marks_of(frequent: DataFrame, length: int, bits: int) -> Marks:
    """The phrases of ``length`` words as 2^bits bits, however many there are."""
    words = F.split("phrase", " ")
    place = _slot(F.col("lang"), [words[k] for k in range(length)], bits) + 1
    rows = (
        frequent.filter(F.col("size") == length)
        .select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    bitmap = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for row in rows:
        bitmap[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return Marks(bitmap, bits)


# --- all shards -----------------------------------------------------------------------

_SHARD = "lang string, sign int, n_words long, words binary, forward binary, backward binary"


class _Held:
    def __init__(self):
        self.number, self.parts, self.size = numbers(), [], 0

    def row(self, lang: str, sign: int) -> dict:
        text = np.concatenate(self.parts)
        used = np.bincount(text, minlength=len(self.number)) > 0
        used[0] = True
        text = (np.cumsum(used) - 1).astype(np.int32)[text]
        words = [w for w, u in zip(self.number, used) if u][1:]
        self.parts, self.size = [], 0
        return {
            "lang": lang, "sign": sign, "n_words": sign * int(np.count_nonzero(text)), "words": b" ".join(words),
            "forward": transform(text).tobytes(), "backward": transform(text[::-1]).tobytes(),
        }


_SHARD_FIELDS = pa.schema([
    ("lang", pa.string()), ("sign", pa.int32()), ("n_words", pa.int64()), ("words", pa.binary()),
    ("forward", pa.binary()), ("backward", pa.binary()),
])


def cuts(ids: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of at most about ``size`` words, cut where pieces end if that is possible, and what each shares with the next."""
    at = 0
    while len(ids) - at > size:
        ends = np.flatnonzero(ids[at : at + size] == 0)
        if len(ends):
            yield ids[at : at + ends[-1] + 1], ids[:0]
            at += int(ends[-1]) + 1
        else:
            shared = ids[at + size - LONGEST + 1 : at + size]
            yield np.append(ids[at : at + size], np.int32(0)), np.append(shared, np.int32(0))
            at += size - LONGEST + 1
    yield ids[at:], ids[:0]


def _into_shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], _Held] = {}

        def made(key: tuple[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([held[key].row(*key)], _SHARD_FIELDS)

        for batch in batches:
            for lang, view in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                key, less = (lang, 1), (lang, -1)
                own = held.setdefault(key, _Held())
                ids = word_ids(bytes(view), own.number)
                for part, shared in cuts(ids, size):
                    if len(shared):
                        off = held.setdefault(less, _Held())
                        names = list(own.number)
                        off.parts.append(np.array([off.number[names[k]] for k in shared.tolist()], np.int32))
                        off.size += len(shared)
                    own.parts.append(part)
                    own.size += len(part)
                    if own.size >= size:
                        yield made(key)
                if not own.size:
                    held.pop(key)
            while sum(h.size for h in held.values()) >= 2 * size:
                key = max(held, key=lambda k: held[k].size)
                yield made(key)
                held.pop(key)
        for key in [k for k, h in held.items() if h.size]:
            yield made(key)
            held.pop(key)

    return run


_GRAM = "lang string, phrase string, size int, n long"


def _counted(length: int, marks: dict[int, Marks]):
    """Shards -> phrases of ``length`` words (1 and 2 at once) with their counts."""

    def rows(lang: str, sign: int, words: pa.Array, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        size = len(phrases.words)
        for a in range(0, len(phrases.size), 50_000):
            own = [words.take(pa.array(w[a : a + 50_000] - 1)) for w in phrases.words]
            phrase = pc.binary_join_element_wise(*own, " ") if size > 1 else own[0]
            counts = pa.array(phrases.size[a : a + 50_000] * sign, pa.int64())
            sizes = pa.array(np.full(len(counts), size, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrase, sizes, counts], ["lang", "phrase", "size", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, sign, _, words, forward, backward = (c[k].as_py() for c in batch.columns)
                words = words.split(b" ")
                shard = Shard(np.frombuffer(forward, np.int32), np.frombuffer(backward, np.int32), len(words))
                names = pa.array(words, pa.binary()).view(pa.string())
                found = shard.single()
                if length <= 2:
                    yield from rows(lang, sign, names, found)
                hashes = np.array([0, *map(_word_hash, words)] if marks else [], np.uint64)
                for size in range(2, length + 1):
                    held = []
                    # To the left and to the right by turns: both indexes are needed, as neither end is fixed.
                    for part in shard.extensions(found, left=size % 2 == 1, last=size == length):
                        if size > 2:
                            part = part.only(marks[size - 1].has(lang, hashes, part.words[:-1]))
                            part = part.only(marks[size - 1].has(lang, hashes, part.words[1:]))
                        if size == length:
                            yield from rows(lang, sign, names, part)
                        else:
                            held.append(part.only(marks[size].has(lang, hashes, part.words)))
                    if size < length:
                        found = together(held)

    return run


def shards_of(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SHARD_WORDS) -> DataFrame:
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return written(texts.mapInArrow(_into_shards(size), _SHARD), "shards", **{"parquet.block.row.count.limit": 1})


def frequent_phrases(shards: DataFrame, least: int = LEAST_COUNT, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, phrase, size, n): the phrases of up to ``LONGEST`` words found at least ``least`` times."""
    found, marks = [], {}
    for length in range(2, LONGEST + 1):
        grams = shards.mapInArrow(_counted(length, marks), _GRAM)
        summed = grams.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        with records_a_batch(shards.sparkSession, 1):
            found.append(written(summed, f"phrases{length}"))
        if length < LONGEST:
            marks[length] = marks_of(found[-1], length, bits)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, top: int = TOP,
    size: int = SHARD_WORDS, bits: int = BITMAP_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, size): each language's best phrases."""
    shards = shards_of(docs, lang_col, text_col, size)
    frequent = frequent_phrases(shards, least, bits)
    totals = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))

    words = F.split("phrase", " ")
    ends = [F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " ")]
    longer = frequent.filter("size > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    candidates = frequent.filter("size > 1").withColumnRenamed("n", "a").join(longer, ["lang", "phrase"], "left")
    candidates = candidates.filter(F.col("longer").isNull() | (100 * _exact(F.col("longer")) < PART_OF * _exact(F.col("a"))))

    cut = candidates.select("lang", "phrase", "size", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("CAST(2000000 * CAST(a AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(38,0)) + r) AS LONG)"))
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("size").cast("long").alias("size"))
