"""Hierarchical multi-length packing (operator 1).

Every document is a row of ids and an end id. Documents longer than the longest
context are cut into full windows and a tail. A tail or short document belongs to
the smallest context tier that holds it. Tiers are packed from the longest down:
the longest piece opens a window, its gap is filled with the largest pieces of the
shorter tiers that fit, and what is then left is filled by cutting one piece, whose
rest stays in its tier. So every window is full but for the last one of a task.
Windows that are made together are dealt to step groups of equal attention cost.

Packing happens where the documents are read: no shuffle, and a task holds one pool
of at most ``POOL`` ids. A task that is run again packs its documents the same way.

Defined results: a null or empty text is its end id alone; rows that repeat a
doc_id are packed as documents of their own; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillvault.llm.common import id_and_text, task_base

TIERS = (128, 256, 512, 1024)
POOL = 1 << 20  # ids a task gathers before it packs them
STEP_TOKENS = 1 << 14
KEPT_WORDS = 500_000  # words whose ids a task remembers

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("tier", pa.int32()),
        ("step_group", pa.int64()),
    ]
)
WITH_IDS = SCHEMA.append(pa.field("ids", pa.list_(pa.int32())))
COLUMNS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class WordIds(dict):
    """Ids (little-endian unsigned 32 bits) of a word with the space before it.

    In a byte-level BPE a space before a non-space always starts a new piece, so
    the ids of a text are those of its words, and a word's last sign is a piece of
    its own. Words of letters and signs below U+0250, which all Unicode tables
    class alike, are encoded from the same vocabulary in its rank form, which is
    several times faster; others, and all words where that form is not given, by
    the tokenizer itself.
    """

    LOOSE = re.compile(r" (?!\S)")
    CUT = re.compile(r" (?=\S)")
    LINES = re.compile(r"([A-Za-z]+[.,;:!?|]?)\n([A-Za-z]+)")
    PLAIN = re.compile(r"[\x20-\x7e\xa1-\u024f\n]*")

    def __init__(self, name: str, ranks: str | None):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # Texts that hold a token added to the vocabulary (an end mark, say) go through the tokenizer whole.
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self.piece = None
        if ranks:
            import base64

            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            coder = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )
            self.fast, self.piece = coder.encode_ordinary, coder._encode_single_piece
        self.line = self.encode("\n")
        self.signs = {sign: self.encode(sign) for sign in ".,;:!?|"}

    def encode(self, text: str) -> bytes:
        if self.fast and self.PLAIN.fullmatch(text):
            return array("I", self.fast(text)).tobytes()
        return self.by_tokenizer(text)

    def by_tokenizer(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if word.isalpha():
            if self.piece and (word.isascii() or max(word) < "\u0250"):
                ids = array("I", self.piece(" " + word)).tobytes()
            else:
                ids = self.encode(" " + word)
        elif (sign := self.signs.get(word[-1])) and word[:-1].isalpha():
            ids = self[word[:-1]] + sign
        elif self.piece and (parts := self.LINES.fullmatch(word)):
            # The end of a line and the first word of the next: not worth keeping.
            head, tail = parts.groups()
            return self[head] + self.line + array("I", self.piece(tail)).tobytes()
        else:
            ids = self.encode(" " + word)
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self.by_tokenizer(text)
        first, *rest = self.CUT.split(text) if self.LOOSE.search(text) else text.split(" ")
        return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, rest))


class Pool:
    """Pieces (doc_id, start, ids, doc_tokens) by length."""

    def __init__(self):
        self.by_length: list[list] = [[] for _ in range(max(TIERS) + 1)]
        self.filled = self.tokens = 0  # filled: bit n is set where there are pieces of n ids

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_length[n].append(piece)
        self.filled |= 1 << n
        self.tokens += n

    def take(self, n: int) -> tuple:
        own = self.by_length[n]
        piece = own.pop()
        if not own:
            self.filled ^= 1 << n
        self.tokens -= n
        return piece

    def longest(self, most: int) -> int:
        return (self.filled & ((2 << most) - 1)).bit_length() - 1

    def next_above(self, n: int) -> int:
        above = self.filled >> (n + 1)
        return n + (above & -above).bit_length() if above else 0


def pack(pool: Pool, last: bool) -> Iterator[tuple[int, list[tuple]]]:
    """(tier, pieces) of each window. Without ``last``, what does not fill a window stays in the pool."""
    while (n := pool.longest(max(TIERS))) > 0:
        tier = next(t for t in TIERS if t >= n)
        window, gap = [pool.take(n)], tier - n
        while gap:
            if (fits := pool.longest(gap)) > 0:
                window.append(pool.take(fits))
                gap -= fits
            elif more := pool.next_above(gap):
                doc, start, ids, total = pool.take(more)
                window.append((doc, start, ids[:gap], total))
                pool.put((doc, start + gap, ids[gap:], total))
                gap = 0
            elif last:
                break
            else:
                for piece in window:
                    pool.put(piece)
                return
        yield tier, window


def step_groups(windows: list[tuple[int, list[tuple]]], first: int) -> list[int]:
    """The group of each window: groups of about STEP_TOKENS ids, the costliest windows dealt first."""
    tokens = sum(tier for tier, _ in windows)
    groups = [(0, first + g) for g in range(max(1, round(tokens / STEP_TOKENS)))]
    costs = [sum(len(p[2]) ** 2 for p in pieces) for _, pieces in windows]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -costs[i]):
        cost, group = groups[0]
        out[i] = group
        heapq.heapreplace(groups, (cost + costs[i], group))
    return out


class Packer:
    """Packs the documents of one task."""

    def __init__(self, base: int, with_ids: bool):
        self.pool, self.full, self.sequence, self.group, self.with_ids = Pool(), [], base, base, with_ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        window, n = max(TIERS), len(ids)
        for start in range(0, n - window + 1, window):
            self.full.append((window, [(doc_id, start, ids[start : start + window], n)]))
        if n % window:
            self.pool.put((doc_id, n - n % window, ids[n - n % window :], n))

    @property
    def tokens(self) -> int:
        return self.pool.tokens + max(TIERS) * len(self.full)

    def flush(self, last: bool = False) -> pa.RecordBatch | None:
        windows = [*self.full, *pack(self.pool, last)]
        self.full = []
        if not windows:
            return None
        rows = []
        groups = step_groups(windows, self.group)
        self.group = max(groups) + 1
        for (tier, pieces), group in zip(windows, groups):
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids)
                rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, at, tier, group))
                at += n
            self.sequence += 1
        arrays = [pa.array(values, field.type) for values, field in zip(zip(*rows), SCHEMA)]
        if not self.with_ids:
            return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)
        ids = pa.array([p[2].astype(np.int32) for _, pieces in windows for p in pieces], WITH_IDS.field("ids").type)
        return pa.RecordBatch.from_arrays([*arrays, ids], schema=WITH_IDS)


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    encoder: Callable[[], Callable[[str], bytes]] | None = None,
) -> DataFrame:
    """One row per piece of a document in a packed window; ``with_ids`` adds its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder() if encoder else WordIds(tokenizer, ranks).of
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(task_base(), with_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.frombuffer(encode(text.as_py()) + end, "<u4"))
                if packer.tokens >= POOL and (out := packer.flush()) is not None:
                    yield out
        if (out := packer.flush(last=True)) is not None:
            yield out

    return id_and_text(docs, id_col, text_col).mapInArrow(run, COLUMNS + ", ids array<int>" * with_ids)
