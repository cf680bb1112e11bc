"""Repair of conversations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import pytest

from tillvault.llm import repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def edits(rows):
    """(cost, letters, repaired) by plain recursion; rows: (role, text, must go, truncated)."""

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if (state, initial) not in NEXT:
                continue
            to = NEXT[state, initial]
            if inserts and (rest := best(i, to, inserts - 1)):
                ways.append((rest[0] + 2, "I" + rest[1], (f"{role}:", *rest[2])))
            if i < len(rows) and not rows[i][2] and (rest := best(i + 1, to, 4)):
                ways.append((rest[0] + 2 + rows[i][3], "R" + rest[1], (f"{role}:{rows[i][1]}", *rest[2])))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            if rest := best(i + 1, state, 4):
                ways.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if not gone and (state, role[:1]) in NEXT and (rest := best(i + 1, NEXT[state, role[:1]], 4)):
                ways.append((rest[0] + cut, "K" + rest[1], (f"{role}:{text}", *rest[2])))
        return min(ways, default=None)

    return best(0, "", 4)


def brute(table):
    """(conv_id, turn, role, text) rows -> results, as the contract says it."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in table:
        own = convs[conv_id]
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if what == 1:
            text = ""
        elif what == 2:
            text = re.sub("[.!?]", "", text)
        elif what == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
    out = Counter()
    for conv_id, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults, plain = set(), Counter(), []
        for _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, said = edits(tuple(plain))
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha] += 1
    return out


def tables():
    rng = random.Random(7)
    texts = ["Yes.", "No!", "cut", "", " \n", None, "a. b", "well?", "same.", "same."]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randint(1, 9)):
            usual = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"{rng.random()}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, turn, 3 * turn, None]), usual, text))
    rows += [(7, 1, "user", "twice the same row.")] * 3 + [(500, None, None, None)] * 2
    # conversations of which the damage leaves nothing
    rows += [(c, 0, "user", "Gone.") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, kind string, runs long, place string"


def frame(spark, rows):
    """With columns of names that the operator uses itself."""
    return spark.createDataFrame([(*r, "k", 1, None) for r in rows], SCHEMA).repartition(3)


def test_conversations(spark):
    rows = tables()
    got = Counter(map(tuple, repair.repair(frame(spark, rows)).collect()))
    assert got == brute(rows)
    assert any(not r[7] and r[8] == hashlib.sha256(b"").hexdigest() for r in got)
    assert repair.repair(frame(spark, []).limit(0)).isEmpty()


@pytest.mark.parametrize("run", [1, 3, repair.RUN])
def test_long_conversations_are_split(spark, run):
    rng = random.Random(5)
    roles = ["user", "assistant", "assistant", "user", "system"]
    rows = [(i // 150, i, rng.choice(roles), rng.choice(["ok.", "cut", f"{rng.random()}!", ""])) for i in range(300)]
    rows += [(9, 4, "user", "the same row.")] * 40 + [(9, 5, "assistant", "the same row.")] * 40 + [(9, None, "user", "early.")] * 3
    got = Counter(map(tuple, repair.repair(frame(spark, rows), run).collect()))
    assert got == brute(rows)


def test_weights_are_ordered_as_cost_and_letters():
    """All sequences of up to five rows of a small alphabet, whole and joined from runs."""
    kinds = {"x": ("user", "", True, False), "s": ("s", "t", False, False), "u": ("u", "t", False, False), "A": ("a", "t", False, True), "o": ("o", "t", False, False)}
    for n in range(5):
        for word in map("".join, product(kinds, repeat=n)):
            cost, letters, _ = edits(tuple(kinds[k] for k in word))
            assert repair.solved(word) == (cost, letters)
            if n > 1:
                width, cells = repair.join(repair.unpacked(repair.packed(repair.table(word[:1]))), repair.table(word[1:]))
                assert repair.read(repair.least(*(cells[0][t] for t in repair.ENDS)), width) == (cost, letters)
