"""Rows that every operator must get right, and fixtures of them."""

from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "kept boolean, print string, row int, c0 string, score double, sha string, id string"
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, odd characters."""
    rng = random.Random(4)
    base, other = words(rng, 120), words(rng, 90)
    near = base.replace(base.split(" ")[60], "changed", 1)
    texts = [
        (0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"),
        (8, "ONE two three"), (9, other + "\n" + base), (10, "é" * 300), (11, "12345 67890"),
        (12, words(rng, 30_000)), (13, "x" * 100_000), (14, "a b  c   d\r\n e f"), (15, other), (15, other),
        (None, base), (None, None), (16, "a line of more than ten words that is here for all to see\n" * 3),
        (17, "A  line of more than ten words that is here for all to see"), (18, "漢字かな交じり文。<|endoftext|>"),
        (19, " wide blank İstanbul"), (20, "idiot clown idiot"), (21, base[:-3]),
    ]
    langs = ["en", "de", None]
    return [
        (i, t, langs[k % 3], [None, "a", "b"][k % 3], None, True, "p", 1, "c", 0.5, "s", "i")
        for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def pairs():
    """(doc_id, text) of the edge rows, null text as empty."""
    return [(r[0], r[1] or "") for r in edge_rows()]
