"""Quality rules on repetition against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_edges import edge, empty, edge_rows, pairs  # noqa: F401

from tillvault.llm import repetition

SCHEMA = "doc_id long, text string"


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    sizes = [len(w) for w in words]

    def covered(n, first):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        times, seen, marked = Counter(grams), set(), set()
        for k, gram in enumerate(grams):
            if times[gram] > 1 and (first or gram in seen):
                marked.update(range(k, k + n))
            seen.add(gram)
        return marked

    seen, n_lines, line_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            n_lines, line_chars = n_lines + 1, line_chars + sum(map(len, own))
        seen.add(line)
    repeat = len(covered(8, True))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    chars = {n: sum(sizes[k] for k in covered(n, False)) for n in repetition.LIMITS}
    kept = not failed and 100 * line_chars <= repetition.LINE_LIMIT * sum(sizes)
    kept = kept and all(100 * chars[n] <= limit * sum(sizes) for n, limit in repetition.LIMITS.items())
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (doc_id, len(words), sum(sizes), symbols, n_lines, repeat, failed, kept, line_chars, *chars.values())


def repeats():
    """Texts with runs, lines and passages said again, of few different words."""
    rng = random.Random(11)
    out = []
    for i in range(150):
        words = [f"w{rng.randint(0, rng.choice([1, 5, 300]))}{'é#'[: rng.randint(0, 2)]}" for _ in range(rng.randint(0, 120))]
        if words and i % 3 == 0:
            words[rng.randrange(len(words)) :] += words[: rng.randint(0, 30)]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", " ", " "]) for w in words)
        out.append((i, text + "\n".join(["again and again", "", "  "] * rng.randint(0, 4))))
    return out


def test_measures(spark, edge, empty, pairs):  # noqa: F811
    assert Counter(map(tuple, repetition.repetition(edge).collect())) == Counter(brute(*p) for p in pairs)
    assert repetition.repetition(empty).isEmpty()
    rows = repeats()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(map(tuple, repetition.repetition(df).collect())) == Counter(brute(*p) for p in rows)


def test_texts_in_groups_and_slices(spark, monkeypatch):
    import pyarrow as pa

    rows = repeats()
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    monkeypatch.setattr(repetition, "GROUP_WORDS", 40)
    monkeypatch.setattr(repetition, "SLICE", 7)
    got = [tuple(r.values()) for b in repetition._judged([batch]) for r in b.to_pylist()]
    assert got == [brute(*p) for p in rows]


@pytest.mark.parametrize("base", [repetition._BASE, 1])
def test_windows_of_equal_hashes_are_told_apart(base):
    """With the factor 1 all orders of the same words have one hash."""
    words = np.array([0, 1, 2, 2, 1, 0, 0, 1, 2, 1, 0, 2, 0, 1, 2], np.int32)
    of = np.array([0] * 9 + [1] * 6)
    windows = repetition.Windows(words, of, base)
    again, later = windows.repeated(3, windows.starts(3, None))
    assert again.tolist() == [0, 6] and later.tolist() == [6]


def test_one_repeated_line_does_not_drop_a_text(spark):
    rng = random.Random(2)
    fresh = " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(100))
    line = "this one line is said twice in the text"
    rows = [(0, f"{line}\n{fresh}\n{line}"), (1, fresh), (2, f"{fresh}\n{fresh}"), (3, (line + "\n") * 40)]
    got = {r.doc_id: r.kept for r in repetition.repetition(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
