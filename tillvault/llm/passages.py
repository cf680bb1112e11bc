"""Substring duplicates by line and paragraph hashing (operator 10).

A text has two kinds of units, compared by their words (runs of ``[^\\x20\\x09-\\x0D]``
with A-Z lower-cased), whatever stands between these:

* its lines that have a word, however short they are;
* paragraphs: runs of adjacent sentences. A sentence ends with a word that ends in
  ``. ! ?`` or with the text; line breaks do not matter. At each sentence a paragraph
  begins, the shortest run of whole sentences from there whose words have at least
  ``LEAST`` characters. So a passage is found inside longer lines and however it is
  wrapped, if whole sentences of that size are in it.

Units are grouped by kind and digest over the whole table. The earliest of a group
stays: by doc_id, then by place in the document. The others go, lines with the line
break after them, paragraphs from their first word up to the word that follows; what a
later unit covers goes even where a first one overlaps it. Where they were (offset and length in
code points) is kept.

A first pass only counts 64-bit hashes of the units; a bitmap of fixed size marks those
that repeat, so that the places and digests of most units never move (false marks cost
work, no results). Groups larger than one in ``SHARE`` of all these units are at most
``SHARE`` in number, so they are joined by broadcast; all others are small. Texts move
once, to be joined with what they lose.

Defined results: null text counts as empty, and has no units; rows that repeat a doc_id
and its text count as one document and get the same result; a null doc_id ranks last;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillvault.llm import shingles
from tillvault.llm.common import id_and_text, utf8, written

LEAST = 100
SHARE = 10_000
BITMAP_BITS = 27
GROUP_BYTES = 4 << 20

LINE, PARAGRAPH = 0, 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ENDS = np.isin(np.arange(256), list(b".!?"))
_BASE = 0x9E3779B97F4A7C15 | 1


def normalised(data: bytes) -> bytes:
    return b" ".join(data.translate(_LOWER).split())


def _key(doc_id: int | None, data: memoryview) -> bytes:
    found = hashlib.blake2b(f"{doc_id}:".encode(), digest_size=16)
    found.update(data)
    return found.digest()


class Units:
    """The units of some texts that lie one after another in ``data``: kind, text, bytes [begin, end) and hash of each."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, least: int = LEAST):
        self.data, self.ends = data, ends
        hashes, places, bounds = shingles.word_places(data, ends)
        self.places, n = places, len(hashes)
        of = np.searchsorted(bounds, np.arange(n), "right") - 1
        spaces = np.append(np.flatnonzero(shingles.is_space(data)), len(data))
        closes = np.minimum(spaces[np.searchsorted(spaces, places)], ends[of + 1])
        steps = np.full(n, _BASE, np.uint64)
        steps[:1] = 1
        powers = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        back = np.multiply.accumulate(steps)
        sums = np.append(np.uint64(0), np.cumsum(hashes * powers, dtype=np.uint64))

        def unit(first: np.ndarray, after: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
            """Words [first, after)."""
            rolled = shingles.mix((sums[after] - sums[first]) * back[first] + (after - first).astype(np.uint64) + np.uint64(kind << 32))
            return np.full(len(first), kind), of[first], places[first], closes[after - 1], rolled

        breaks = np.flatnonzero(data == 10)
        # Words of one line have as many breaks before them, and are of one text.
        line = np.searchsorted(breaks, places)
        opens = np.flatnonzero(np.diff(line, prepend=-1).astype(bool) | np.diff(of, prepend=-1).astype(bool))
        lines = unit(opens, np.append(opens[1:], n), LINE)

        self.chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) if len(data) else np.zeros(0, np.int32)
        self.chars = np.append(np.int32(0), self.chars)
        size = np.append(0, np.cumsum(self.chars[closes] - self.chars[places]))
        last = _ENDS[data[closes - 1]] if n else np.zeros(0, bool)
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        after = np.flatnonzero(last) + 1
        first = np.append(0, after[:-1]) if len(after) else after
        end = np.searchsorted(size[after], size[first] + least)
        fits = np.flatnonzero(end < len(after))
        fits = fits[of[first[fits]] == of[after[end[fits]] - 1]]
        paragraphs = unit(first[fits], after[end[fits]], PARAGRAPH)
        self.kind, self.text, self.begin, self.end, self.hash = (np.concatenate(c) for c in zip(lines, paragraphs))

    def spans(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What goes with each unit: start in its text and length, in code points. A line goes whole, with its break."""
        limit = self.ends[self.text[chosen] + 1]
        begin, end, base = self.begin[chosen], self.end[chosen], self.ends[self.text[chosen]]
        breaks = np.flatnonzero(self.data == 10)
        lines = self.kind[chosen] == LINE
        before = np.searchsorted(breaks, begin)
        opened = np.append(-1, breaks)[before] + 1
        closed = np.append(breaks, len(self.data))[before] + 1
        begin = np.where(lines, np.maximum(opened, base), begin)
        following = np.append(self.places, len(self.data))[np.searchsorted(self.places, end)]
        end = np.minimum(np.where(lines, closed, following), limit)
        return self.chars[begin] - self.chars[base], self.chars[end] - self.chars[begin]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, bytes, ends) of some texts at a time."""
    for batch in batches:
        ids, views, a = batch.column(0).to_pylist(), utf8(batch.column(1)), 0
        while a < len(ids):
            b, held = a, 0
            while b < len(ids) and (b == a or held + len(views[b]) <= GROUP_BYTES):
                held += len(views[b])
                b += 1
            ends = np.cumsum([0, *map(len, views[a:b])])
            yield ids[a:b], np.frombuffer(b"".join(views[a:b]), np.uint8), ends
            a = b


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, ends in _groups(batches):
            hashes = Units(data, ends, least).hash
            for a in range(0, len(hashes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[a : a + 100_000].view(np.int64))], ["hash"])

    return run


def repeated_hashes(texts: DataFrame, least: int = LEAST, bits: int = BITMAP_BITS) -> np.ndarray:
    """2^bits bits: which hashes of units occur more than once."""
    counts = texts.mapInArrow(_hashed(least), "hash long").groupBy("hash").count().filter("count > 1")
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    marks = counts.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    bitmap = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for row in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        bitmap[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return bitmap


_UNITS = "doc_id long, key binary, kind int, start long, length long, digest binary"
_UNIT_NAMES = [p.split()[0] for p in _UNITS.split(", ")]


def _marked(bitmap, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        for ids, data, ends in _groups(batches):
            units, whole = Units(data, ends, least), memoryview(data)
            slot = (units.hash & np.uint64((1 << bits) - 1)).astype(np.int64)
            chosen = np.flatnonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if not len(chosen):
                continue
            texts, kinds = units.text[chosen], units.kind[chosen]
            keys = {t: _key(ids[t], whole[ends[t] : ends[t + 1]]) for t in set(texts.tolist())}
            start, length = units.spans(chosen)
            digests = [
                hashlib.blake2b(normalised(bytes(whole[a:b])), digest_size=16, salt=bytes([kind])).digest()
                for a, b, kind in zip(units.begin[chosen].tolist(), units.end[chosen].tolist(), kinds.tolist())
            ]
            columns = [
                pa.array([ids[t] for t in texts.tolist()], pa.int64()), pa.array([keys[t] for t in texts.tolist()], pa.binary()),
                pa.array(kinds, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digests, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, _UNIT_NAMES)

    return run


def later_units(units: DataFrame, share: int = SHARE) -> DataFrame:
    """The units of which an equal one comes earlier."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    firsts = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    firsts = written(firsts, "firsts")
    hot = max(2, units.count() // share)
    large, small = firsts.filter(F.col("rows") > hot), firsts.filter(F.col("rows") <= hot)
    later = (F.col("key") != F.col("first.key")) | (F.col("start") != F.col("first.start"))
    common = units.join(F.broadcast(large), "digest").filter(later)
    rest = units.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(small, "digest").filter(later)
    return common.unionByName(rest).drop("first", "rows", "digest")


def lost_units(texts: DataFrame, least: int = LEAST, bits: int = BITMAP_BITS, share: int = SHARE) -> DataFrame:
    """(key, lost): the later units of each document, with their places."""
    bitmap = texts.sparkSession.sparkContext.broadcast(repeated_hashes(texts, least, bits))
    units = written(texts.mapInArrow(_marked(bitmap, bits, least), _UNITS), "units")
    # One document's units: as many as it has, whatever the table holds.
    return later_units(units, share).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "length")).alias("lost"))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """[start, end) spans as few, apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_OUT_FIELDS = [
    ("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_lines", pa.int64()), ("n_passages", pa.int64()),
    ("n_chars", pa.int64()), ("kept_chars", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS), ("kept_text", pa.string()),
]
_OUT = (
    "doc_id long, n_removed long, n_lines long, n_passages long, n_chars long, kept_chars long, kept_sha256 string, "
    "spans array<struct<start:long,length:long>>, kept_text string"
)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lost) -> the result of each document."""
    for whole in batches:
        for i in range(0, whole.num_rows, 200):
            batch, rows = whole.slice(i, 200), []
            for doc_id, value, lost in zip(*(batch.column(k) for k in range(3))):
                text, units = value.as_py(), lost.as_py() or []
                gone = [[(u["start"], u["start"] + u["length"]) for u in units if u["kind"] == k] for k in (LINE, PARAGRAPH)]
                spans, passages, kept, at = union_of(gone[0] + gone[1]), union_of(gone[1]), [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                left = "".join([*kept, text[at:]])
                places = [{"start": a, "length": b - a} for a, b in spans]
                sha = hashlib.sha256(left.encode()).hexdigest()
                rows.append((doc_id.as_py(), len(spans), len(gone[0]), len(passages), len(text), len(left), sha, places, left))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, (_, k) in zip(zip(*rows), _OUT_FIELDS)], [n for n, _ in _OUT_FIELDS]
            )


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key(i, t) for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["doc_id", "text", "key"])


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, bits: int = BITMAP_BITS, share: int = SHARE
) -> DataFrame:
    """(doc_id, n_removed, n_lines, n_passages, n_chars, kept_chars, kept_sha256, spans, kept_text) of every row.

    n_removed: removed stretches of text; n_lines: lines in them that repeat; n_passages: stretches of repeated paragraphs.
    """
    texts = id_and_text(docs, id_col, text_col)
    lost = lost_units(texts, least, bits, share)
    keyed = texts.mapInArrow(_with_key, "doc_id long, text string, key binary")
    return keyed.join(lost, "key", "left").select("doc_id", "text", "lost").mapInArrow(_applied, _OUT)
