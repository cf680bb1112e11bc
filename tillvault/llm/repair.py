"""Repair of conversation structure (operator 11).

The edits of a conversation are a path through a graph: its nodes are (rows done, state
of the role pattern ``(s?(ua)+)?``), its edges keep, rerole, delete or insert. A path's
weight is one big integer. Its high digits are the cost. Below lie ``width`` digits of
three bits, one place per edit from the front: 1 to 4 for D, I, K, R in ASCII order, and
0 beyond the end. So the least integer is the cheapest path, and of those the one whose
letters are ASCII-least, and an ordinary shortest path decides everything. The letters
give the edits, and the state before a letter the role it sets.

Long conversations are split. Rows are laid out by (conversation, turn, role, digest of
the text) in ranges, which divide a conversation however many rows it has; every run of
up to ``RUN`` rows of a conversation becomes a table of 4 x 4 weights, the best way from
each state to each. Two such tables join into one: paths of one cell with equal cost
have no letters of which one begins the other (both delete, keep or rerole the same rows,
and a longer one would hold a further insert and so cost more), so the order of weights
holds whatever follows. Runs are joined in pairs, pairs in pairs, and so on. Which rows
say again what was said before is found by the first place of each (conversation, role,
digest), summed before it is shuffled; only digests move. Texts move once, to be hashed
in their order: a digest of a whole conversation is taken in one task by its nature, but
row by row, so that task's memory holds the letters and one batch.

Defined results: null counts as one space in role and text, and in the text that decides
the damage; a null turn comes first; rows with equal turns are ordered by role and the
SHA-256 of their text; null conv_ids are one conversation; a conversation whose rows are
all dropped has zeros, no letters and the hash of an empty string; other columns are
ignored; an empty table gives no rows. The initial of a role is its first character; a
role without one fits nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256

#: States of the role pattern: nothing yet, after s, after u, after a.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = (0, 3)
SET = {"u": "user", "a": "assistant"}
RIGHT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role of user and assistant that may follow
LETTERS = "\0DIKR"
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
BITS = 3
INSERTS = 3  # more between two rows come back to a state they have been in

#: A row for the graph: x must go; s, u, a, o by its role, in capitals where it is truncated.
MUST_GO = "x"

Weight = int | None
Table = tuple[int, list[list[Weight]]]  # width, best weight from each state to each


def step(weight: Weight, width: int, letter: str, cost: int) -> Weight:
    """The weight of ``letter`` and then the path."""
    if weight is None:
        return None
    low = width * BITS
    places = (weight & ((1 << low) - 1)) >> BITS | LETTERS.index(letter) << (low - BITS)
    return ((weight >> low) + cost) << low | places


def least(*weights: Weight) -> Weight:
    return min((w for w in weights if w is not None), default=None)


def _inserted(after: list[Weight], width: int) -> list[Weight]:
    best = list(after)
    for _ in range(INSERTS):
        best = [least(after[q], step(best[NEXT[q, RIGHT[q]]], width, "I", COSTS["I"])) for q in STATES]
    return best


def shortest(kinds: str, ends: tuple[int, ...], width: int) -> list[Weight]:
    """The least weight from each state before the rows to one of ``ends`` after them."""
    best = _inserted([0 if q in ends else None for q in STATES], width)
    for kind in reversed(kinds):
        rows = []
        for q in STATES:
            ways = [step(best[q], width, "D", COSTS["D"])]
            if kind != MUST_GO:
                more = TRUNCATED * kind.isupper()
                ways.append(step(best[NEXT[q, RIGHT[q]]], width, "R", COSTS["R"] + more))
                if (to := NEXT.get((q, kind.lower()))) is not None:
                    ways.append(step(best[to], width, "K", COSTS["K"] + more))
            rows.append(least(*ways))
        best = _inserted(rows, width)
    return best


def width_of(kinds: str) -> int:
    return len(kinds) * (INSERTS + 1) + INSERTS


@lru_cache(1 << 14)
def solved(kinds: str) -> tuple[int, str]:
    """Cost and letters of the best edits of a whole conversation."""
    width = width_of(kinds)
    return read(shortest(kinds, ENDS, width)[0], width)


@lru_cache(1 << 12)
def table(kinds: str) -> Table:
    width = width_of(kinds)
    columns = [shortest(kinds, (t,), width) for t in STATES]
    return width, [[columns[t][q] for t in STATES] for q in STATES]


def _places(weight: int, width: int) -> int:
    """How many letters a weight has."""
    low = weight & ((1 << width * BITS) - 1)
    empty = ((low & -low).bit_length() - 1) // BITS if low else width
    return width - empty


def join(a: Table, b: Table) -> Table:
    """The best ways through ``a`` and then ``b``."""
    (wa, first), (wb, second) = a, b
    width, out = wa + wb, []

    def both(x: Weight, y: Weight) -> Weight:
        if x is None or y is None:
            return None
        low, gap = width * BITS, wa - _places(x, wa)
        places = (x & ((1 << wa * BITS) - 1)) << wb * BITS | (y & ((1 << wb * BITS) - 1)) << gap * BITS
        return ((x >> wa * BITS) + (y >> wb * BITS)) << low | places

    for q in STATES:
        out.append([least(*(both(first[q][m], second[m][t]) for m in STATES)) for t in STATES])
    return fitted((width, out))


def fitted(t: Table) -> Table:
    """The same weights in no more places than they need."""
    width, cells = t
    need = max((_places(w, width) for row in cells for w in row if w is not None), default=0)
    less = (width - need) * BITS
    return need, [[w if w is None else w >> less for w in row] for row in cells]


def read(weight: int, width: int) -> tuple[int, str]:
    """Cost and letters of a weight."""
    digits = f"{weight & ((1 << width * BITS) - 1):0{max(1, width)}o}"  # octal: three bits a digit
    return weight >> width * BITS, digits.rstrip("0").translate({48 + k: c for k, c in enumerate(LETTERS)})


def packed(t: Table) -> bytes:
    width, cells = t
    parts = [width.to_bytes(8, "big")]
    for row in cells:
        for w in row:
            body = b"" if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big")
            parts += [len(body).to_bytes(8, "big"), body]
    return b"".join(parts)


def unpacked(data: bytes) -> Table:
    width, at, cells = int.from_bytes(data[:8], "big"), 8, []
    for _ in STATES:
        row = []
        for _ in STATES:
            size = int.from_bytes(data[at : at + 8], "big")
            row.append(int.from_bytes(data[at + 8 : at + 8 + size], "big") if size else None)
            at += 8 + size
        cells.append(row)
    return width, cells


# --- runs of rows -------------------------------------------------------------------

_RUNS = (
    "conv_id long, part int, run long, kinds string, weights binary, turn_first long, turn_last long, turns long, "
    "first string, last string, rows long, illegal long, blank long, duplicate long, truncated long"
)


class _Run:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kinds, self.turns, self.turn_first, self.turn_last = conv_id, [], 0, None, None
        self.first = self.last = None
        self.illegal, self.faults = 0, {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, initial: str, kind: str, fault: str | None) -> None:
        if turn is not None and turn != self.turn_last:
            self.turns, self.turn_last = self.turns + 1, turn
            self.turn_first = turn if self.turn_first is None else self.turn_first
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.first, self.last = initial if self.first is None else self.first, initial
        self.kinds.append(kind)
        if fault:
            self.faults[fault] += 1

    def row(self, part: int, number: int, whole: bool) -> dict:
        kinds = "".join(self.kinds)
        return {
            "conv_id": self.conv_id, "part": part, "run": number, "kinds": kinds if whole else None,
            "weights": None if whole else packed(fitted(table(kinds))), "turn_first": self.turn_first,
            "turn_last": self.turn_last, "turns": self.turns, "first": self.first, "last": self.last,
            "rows": len(kinds), "illegal": self.illegal, **self.faults,
        }


_RUN_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("kinds", pa.string()), ("weights", pa.binary()),
    ("turn_first", pa.int64()), ("turn_last", pa.int64()), ("turns", pa.int64()), ("first", pa.string()),
    ("last", pa.string()), ("rows", pa.int64()), ("illegal", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()),
])


def _into_runs(size: int):
    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (conv_id, turn, initial, kind, fault) -> runs. One that may be all of its conversation hands on its kinds."""
        context = TaskContext.get()
        part, number, run, out, went_on = context.partitionId() if context else 0, 0, None, [], False
        for batch in batches:
            for conv_id, turn, initial, kind, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if run is None or run.conv_id != conv_id or len(run.kinds) >= size:
                    same = run is not None and run.conv_id == conv_id
                    if run is not None:
                        out.append(run.row(part, number, not same and not went_on))
                        number += 1
                    went_on, run = same, _Run(conv_id)
                if kind:
                    run.add(turn, initial, kind, fault)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, _RUN_FIELDS)
                out = []
        if run is not None:
            out.append(run.row(part, number, not went_on))
            yield pa.RecordBatch.from_pylist(out, _RUN_FIELDS)

    return run_rows


class _Whole:
    """A conversation put together from its runs, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parts, self.hash, self.at, self.state, self.said = conv_id, [], hashlib.sha256(), 0, 0, False
        self.turns, self.turn_first, self.turn_last, self.last = 0, None, None, None
        self.sums = {"illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}
        self.edits: tuple[int, str] | None = None

    def add_run(self, row: dict) -> None:
        for name in self.sums:
            self.sums[name] += row[name]
        if row["rows"]:
            self.sums["illegal"] += self.last is not None and self.last + row["first"] not in ("su", "ua", "au")
            self.last = row["last"]
            self.push(0, row)
        if row["turns"]:
            self.turns += row["turns"] - (row["turn_first"] == self.turn_last)
            self.turn_first = row["turn_first"] if self.turn_first is None else self.turn_first
            self.turn_last = row["turn_last"]

    def push(self, level: int, item) -> None:
        """Pairs are joined as in a binary counter: a run takes part in log(runs) joins."""
        while self.parts and self.parts[-1][0] == level:
            item, level = join(_table_of(self.parts.pop()[1]), _table_of(item)), level + 1
        self.parts.append((level, item))

    def solve(self) -> str:
        if self.edits is None:
            if len(self.parts) == 1 and isinstance(self.parts[0][1], dict) and self.parts[0][1]["kinds"] is not None:
                self.edits = solved(self.parts[0][1]["kinds"])
            elif self.parts:
                whole = _table_of(self.parts.pop()[1])
                while self.parts:
                    whole = join(_table_of(self.parts.pop()[1]), whole)
                self.edits = read(least(*(whole[1][0][t] for t in ENDS)), whole[0])
            else:
                self.edits = solved("")
            self.parts = []
        return self.edits[1]

    def say(self, role: str, text: str) -> None:
        if self.said:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.said = True
        self.state = NEXT[self.state, role[0]]

    def insert(self) -> None:
        letters = self.solve()
        while self.at < len(letters) and letters[self.at] == "I":
            self.say(SET[RIGHT[self.state]], "")
            self.at += 1

    def add_text(self, role: str, text: str) -> None:
        self.insert()
        letter = self.solve()[self.at]
        self.at += 1
        if letter != "D":
            self.say(role if letter == "K" else SET[RIGHT[self.state]], text)

    def result(self) -> dict:
        self.insert()
        gaps = self.turn_last - self.turn_first + 1 - self.turns if self.turns else 0
        return {
            "conv_id": self.conv_id, "gaps": gaps, **{n: self.sums[n] for n in ("blank", "duplicate", "truncated", "illegal")},
            "cost": self.edits[0], "audit": self.edits[1], "repaired_sha256": self.hash.hexdigest(),
        }


def _table_of(item) -> Table:
    if isinstance(item, tuple):
        return item
    return fitted(table(item["kinds"])) if item["kinds"] is not None else unpacked(item["weights"])


_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OUT_FIELDS = pa.schema([(p.split()[0], pa.int64() if p.endswith("long") else pa.string()) for p in _OUT.split(", ")])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by conversation: its runs, then its texts -> the result of each conversation."""
    whole, out = None, []
    for batch in batches:
        for conv_id, run, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "runs", "role", "text"))):
            if whole is None or whole.conv_id != conv_id:
                if whole is not None:
                    out.append(whole.result())
                whole = _Whole(conv_id)
            if run is not None:
                whole.add_run(run)
            else:
                whole.add_text(role, text)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _OUT_FIELDS)
            out = []
    if whole is not None:
        out.append(whole.result())
        yield pa.RecordBatch.from_pylist(out, _OUT_FIELDS)


# --- the tables ---------------------------------------------------------------------

_BLANKS = " \t\n\x0b\f\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sha, place, gone): the rows after damage; a dropped row stays as one that is gone."""

    def words(column: str) -> Column:
        return F.coalesce(conversations[column].cast("string"), F.lit(" "))

    what = F.crc32(F.concat_ws(":", words("conv_id"), words("turn")).cast("binary")) % 20
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.when(what == 4, F.lit("user")).otherwise(words("role")).alias("role"),
        F.when(what == 1, F.lit("")).when(what == 2, F.translate(words("text"), ".!?", "")).otherwise(words("text")).alias("text"),
        (what == 0).alias("gone"),
        F.monotonically_increasing_id().alias("row"),
        F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    place = F.struct("turn", "row", "copy")
    return rows.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("sha"), place.alias("place"), "gone")


ORDER = ("conv_id", "turn", "role", "sha", "place")


def judged(rows: DataFrame) -> DataFrame:
    """The rows without texts: initial, kind for the graph, and the first fault. Rows that are gone have no kind."""
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    narrow = rows.select(
        "conv_id", "turn", "role", "sha", "place", "gone", (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    said = ["conv_id", "role", "sha"]
    firsts = narrow.filter("NOT gone AND NOT blank").groupBy(*said).agg(F.min("place").alias("first_place"), F.count("*").alias("times"))
    again = firsts.filter("times > 1").select(*(F.col(c).alias(f"own_{c}") for c in said), "first_place")
    same = F.col("conv_id").eqNullSafe(F.col("own_conv_id")) & (F.col("role") == F.col("own_role")) & (F.col("sha") == F.col("own_sha"))
    found = narrow.join(again, same, "left")
    later = F.col("first_place").isNotNull() & (F.col("place") != F.col("first_place"))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(known)).otherwise(known)
    return found.select(*ORDER, initial.alias("initial"), F.when(~F.col("gone"), kind).alias("kind"), fault.alias("fault"))


def repair(conversations: DataFrame, run: int = RUN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id."""
    rows = damaged(conversations)
    laid = judged(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    runs = laid.select("conv_id", "turn", "initial", "kind", "fault").mapInArrow(_into_runs(run), _RUNS)
    keys = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("sha", "string"))]
    place = F.struct(F.lit(None).cast("long").alias("turn"), F.col("part").cast("long").alias("row"), F.col("run").cast("int").alias("copy"))
    ahead = runs.select("conv_id", *keys, place.alias("place"), F.lit(None).cast("string").alias("text"), F.struct(*runs.columns[3:]).alias("runs"))
    none = F.lit(None).cast(ahead.schema["runs"].dataType).alias("runs")
    both = ahead.unionByName(rows.filter("NOT gone").select(*ORDER, "text", none))
    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("runs").isNull(), *ORDER[1:])
    return in_order.mapInArrow(_repaired, _OUT)
