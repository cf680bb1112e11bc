"""Quality rules on repetition (operator 12).

A text is cut into words, the runs of ``[^\\x20\\x09-\\x0D]``. For each length of
``LENGTHS`` the n-grams that a text holds more than once are found by rolling hashes:
one running sum of word numbers times powers of an odd number gives the hash of any
window by one subtraction. Windows of equal hashes are compared word by word, so no
hash decides by itself. An n-gram can only be found twice if both n-1-grams in it are,
so longer windows are looked for among the places the shorter ones leave.

Measured are the characters inside n-grams found earlier in the text (overlaps count
once) and inside lines found earlier. A text is kept if it passes the base rules and
no measure is above its limit (``LIMITS``, ``LINE_LIMIT``: percent of all characters
in words). The limits are parameters of the operator, the same for all texts.

Each text is judged by itself, where it is read: nothing is shuffled. Word numbers and
windows live in numpy arrays of about 2^18 words or of one text.

Defined results: null and empty texts have no words, fail the base rules and are not
kept; texts shorter than a window have no n-grams of that length; rows that repeat are
judged each; a null doc_id is handed on; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillvault.llm.common import id_and_text, utf8
from tillvault.llm.shingles import mix

#: Percent of the characters that n-grams found earlier may cover, by length.
LIMITS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
LINE_LIMIT = 30
LEAST_WORDS = 20
BASE_LENGTH, BASE_LIMIT = 8, 30

GROUP_WORDS = 1 << 18
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOLS = b"#*$%&|<>"
_WITHIN = bytes(range(0x80, 0xC0))  # bytes that begin no character
_SPACES = b" \t\n\x0b\f\r"


def points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else len(data.translate(None, _WITHIN))


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of about SLICE bytes that cut no word."""
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[at:end]
        at = end


def repeated_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier line, and the characters of their words."""
    seen: set[bytes] = set()
    lines = chars = 0
    if b"\n" not in data:
        return 0, 0
    for line in data.split(b"\n"):
        if line in seen:
            lines += 1
            chars += points(line.translate(None, _SPACES))
        elif line and not line.isspace():
            seen.add(line)
    return lines, chars


class Windows:
    """The repeated n-grams of several texts: words as numbers, ``of`` the text of each word."""

    def __init__(self, words: np.ndarray, of: np.ndarray, base: int = _BASE):
        self.words, self.of, n = words, of, len(words)
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        powers = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(base, -1, 1 << 64))
        self.back = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * powers, out=self.sums[1:])

    def starts(self, length: int, within: np.ndarray | None) -> np.ndarray:
        """Places where a window fits into one text; ``within``: starts of the repeated windows one word shorter."""
        if within is None:
            at = np.arange(max(0, len(self.words) - length + 1))
        else:
            at = within[:-1][within[1:] == within[:-1] + 1]
        return at[self.of[at] == self.of[at + length - 1]] if len(at) else at

    def repeated(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows at ``at`` (ascending): those found twice or more in their text, and those found earlier in it."""
        own = self.of[at].astype(np.uint64)
        key = mix((self.sums[at + length] - self.sums[at]) * self.back[at] + mix(own))
        order = np.argsort(key, kind="stable")
        near = key[order[1:]] == key[order[:-1]]
        a, b = at[order[:-1][near]], at[order[1:][near]]
        equal = self.of[a] == self.of[b]
        for k in range(length):
            equal &= self.words[a + k] == self.words[b + k]
        if not equal.all():  # two n-grams share a hash: sort by the words themselves
            order = np.lexsort([*(self.words[at + k] for k in range(length)), self.of[at]])
            a, b = at[order[:-1]], at[order[1:]]
            equal = self.of[a] == self.of[b]
            for k in range(length):
                equal &= self.words[a + k] == self.words[b + k]
            a, b = a[equal], b[equal]
        return np.union1d(a, b), np.sort(b)

    def covered(self, at: np.ndarray, length: int) -> np.ndarray:
        """Which words the windows at ``at`` cover."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        return np.cumsum(edge[:-1]) > 0


def _measured(ids: list, rows: list[tuple], chars_of: np.ndarray) -> dict[str, list]:
    """rows: (word numbers, n_symbols, repeated lines, their characters); chars_of: the characters of each word number."""
    sizes = np.array([len(r[0]) for r in rows], np.int64)
    words = np.concatenate([r[0] for r in rows]) if len(rows) else np.zeros(0, np.int32)
    of = np.repeat(np.arange(len(rows)), sizes)
    chars = chars_of[words]

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, len(rows)).astype(np.int64)

    windows, within, counts, cover = Windows(words, of), None, np.zeros(len(rows), np.int64), {}
    for length in sorted({*LIMITS, BASE_LENGTH}):
        within, later = windows.repeated(length, windows.starts(length, within))
        if length == BASE_LENGTH:
            counts = per_text(windows.covered(within, length))
        cover[length] = per_text(chars * windows.covered(later, length))
    word_chars = per_text(chars)
    line_chars = np.array([r[3] for r in rows], np.int64)
    failed = (sizes < LEAST_WORDS) | (100 * counts > BASE_LIMIT * sizes)
    kept = ~failed & (100 * line_chars <= LINE_LIMIT * word_chars)
    for length, limit in LIMITS.items():
        kept &= 100 * cover[length] <= limit * word_chars
    return {
        "doc_id": ids, "n_words": sizes, "word_chars": word_chars,
        "n_symbols": [r[1] for r in rows], "n_dup_lines": [r[2] for r in rows], "n_repeat_words": counts,
        "base_failed": failed, "kept": kept, "dup_line_chars": line_chars,
    } | {f"dup_chars_{n}": cover[n] for n in LIMITS}


_KINDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("dup_line_chars", pa.int64()), *((f"dup_chars_{n}", pa.int64()) for n in LIMITS),
]
_OUT = ", ".join(f"{name} {'boolean' if kind == pa.bool_() else 'long'}" for name, kind in _KINDS)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def result() -> pa.RecordBatch:
        chars_of = np.fromiter(map(points, number), np.int64, len(number))
        columns = _measured(ids, rows, chars_of)
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in _KINDS], [c for c, _ in _KINDS])

    number: dict[bytes, int] = defaultdict(count().__next__)
    ids, rows, held = [], [], 0
    for batch in batches:
        for doc_id, view in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            data = bytes(view)
            parts = [np.fromiter(map(number.__getitem__, part.split()), np.int32) for part in _slices(data)]
            words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            symbols = len(data) - len(data.translate(None, _SYMBOLS))
            ids.append(doc_id)
            rows.append((words, symbols, *repeated_lines(data)))
            held += len(words)
            if held >= GROUP_WORDS or len(rows) >= 10_000:
                yield result()
                number = defaultdict(count().__next__)
                ids, rows, held = [], [], 0
    if rows:
        yield result()


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars, dup_chars_n...)."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_judged, _OUT)
