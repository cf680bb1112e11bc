"""Phrases from indexed shards against counting."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_edges import edge, empty, edge_rows  # noqa: F401

from tillvault.llm import phrases

_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, phrase string, size int, n string"


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER))]


def counted(rows):
    out = Counter()
    for text, lang in rows:
        for w in pieces(text):
            for size in range(1, 5):
                out.update((lang or "und", size, tuple(w[k : k + size])) for k in range(len(w) - size + 1))
    return out


def brute(rows, least, top):
    f = {k: c for k, c in counted(rows).items() if c >= least}
    totals = Counter()
    for text, lang in rows:
        totals[lang or "und"] += sum(map(len, pieces(text)))
    best = []
    for (lang, size, w), a in f.items():
        if size < 2:
            continue
        inside = any(
            o == lang and n > size and 100 * c >= 80 * a and any(v[k : k + size] == w for k in range(n - size + 1))
            for (o, n, v), c in f.items()
        )
        if not inside:
            ways = []
            for k in range(1, size):
                l, r = f[lang, k, w[:k]], f[lang, size - k, w[k:]]
                ways.append((2000000 * a // (l + r), k, l, r))
            score, _, l, r = min(ways)
            best.append((lang, -score, -a, " ".join(w).encode(), l, r))
    out, rank = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(best):
        rank[lang] += 1
        if rank[lang] <= top:
            out.add((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "Ünder", "of", "the", "漢字", "a\xa0b", "x", "y", "z"]
    out = []
    for _ in range(n):
        said = [rng.choice(words[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 60))]
        out.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for w in said), rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize(("size", "bits"), [(phrases.SHARD_WORDS, phrases.BITMAP_BITS), (50, 6)])
def test_collocations(spark, size, bits):
    rows = texts(3, 120) + [(None, "en"), ("", None), (" . \n", "fr"), ("fresh and new", "es"), ("new york " * 400, "en")]
    df = spark.createDataFrame([(i, t, lang, "p", 1, "n") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = phrases.collocations(df, least=5, top=40, size=size, bits=bits).drop("size").collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 40) and len(got) > 40


def test_edges(spark, edge, empty):  # noqa: F811
    rows = [(r[1], r[2]) for r in edge_rows()]
    got = phrases.collocations(edge, least=2).drop("size").collect()
    assert len(got) > 20 and {tuple(r) for r in got} == brute(rows, 2, phrases.TOP)
    assert phrases.collocations(empty).isEmpty()


@pytest.mark.parametrize("seed", range(5))
def test_intervals_count_phrases(seed):
    """Both directions give the counts of plain counting, whichever comes first."""
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(0, 4, 300), 0).astype(np.int32)
    text = text[(text != 0) | (np.roll(text, 1) != 0)]
    shard = phrases.Shard(phrases.transform(text), phrases.transform(text[::-1]), 3)
    wanted = Counter(tuple(text[k : k + n]) for n in range(1, 5) for k in range(len(text) - n + 1) if 0 not in text[k : k + n])
    for sides in ([False] * 3, [True] * 3, [False, True, False], [True, False, True]):
        found = shard.single()
        for n, left in enumerate(sides, 2):
            found = shard.extended(found, left)
            got = {tuple(int(x) for x in w): int(c) for w, c in zip(zip(*found.words), found.size)}
            assert got == {w: c for w, c in wanted.items() if len(w) == n}


def test_pieces_longer_than_a_shard_count_once():
    ids = np.array([*np.random.default_rng(1).integers(1, 5, 200), 0, 3, 0, *[2] * 90, 0], np.int32)
    sums = Counter()
    for part, shared in phrases.cuts(ids, 20):
        assert len(part) <= 21
        for sign, run in ((1, part), (-1, shared)):
            for n in range(1, 5):
                for k in range(len(run) - n + 1):
                    if 0 not in run[k : k + n]:
                        sums[tuple(run[k : k + n])] += sign
    wanted = Counter(tuple(ids[k : k + n]) for n in range(1, 5) for k in range(len(ids) - n + 1) if 0 not in ids[k : k + n])
    assert +sums == wanted and min(sums.values()) >= 0


def test_a_task_holds_one_shard_at_a_time(spark, monkeypatch):
    """A row group and an Arrow batch are one shard, however many a task reads (round 4, F1)."""
    df = spark.createDataFrame([(i, t, lang, "p", 1, "n") for i, (t, lang) in enumerate(texts(4, 120))], SCHEMA).coalesce(1)
    shards = phrases.shards_of(df, size=100)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 20 and set(groups) == {1}

    counted = phrases._counted

    def watched(length, marks):
        run = counted(length, marks)

        def alone(batches):
            for batch in batches:
                assert batch.num_rows == 1
                yield from run(iter([batch]))

        return alone

    monkeypatch.setattr(phrases, "_counted", watched)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert phrases.frequent_phrases(shards, least=5).count() > 40
    assert spark.conf.get(key) == before


def shard_batch(words, symbols, seed):
    """A batch of one shard, as it is read, of random words numbered from 1."""
    text = np.append(np.random.default_rng(seed).integers(1, symbols, words), 0).astype(np.int32)
    text[:symbols - 1] = np.arange(1, symbols)
    names = b" ".join(b"w%d" % k for k in range(1, symbols))
    row = {"lang": "en", "sign": 1, "n_words": words, "words": names, "forward": phrases.transform(text).tobytes(), "backward": phrases.transform(text[::-1]).tobytes()}
    return pa.RecordBatch.from_pylist([row], phrases._SHARD_FIELDS)


def test_memory_of_counting_a_shard():
    """Counting the pairs of a shard of N words takes less than 64 N bytes beside it (round 4, F1)."""
    words = 1 << 19
    batch = shard_batch(words, 20_000, 0)
    tracemalloc.start()
    found = sum(out.num_rows for out in phrases._counted(2, {})(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > words / 2 and peak < 64 * words


@pytest.mark.parametrize("seed", range(3))
def test_parts_of_an_extension_are_the_whole(seed):
    batch = shard_batch(2_000, 40, seed)
    shard = phrases.Shard(*(np.frombuffer(c[0].as_py(), np.int32) for c in batch.columns[4:]), 39)
    found = shard.single()
    for left in (False, True, False):
        whole = shard._extended(found, left, False)
        for rows in (1, 37, 500, 10_000):
            parts = [*shard.extensions(found, left, rows=rows)]
            assert (len(parts) > 1) == (rows < 2_000)
            joined = phrases.together(parts)
            for a, b in zip([*whole.words, whole.forward, whole.backward, whole.size], [*joined.words, joined.forward, joined.backward, joined.size], strict=True):
                assert np.array_equal(a, b)
        found = whole
    none = found.only(np.zeros(len(found.size), bool))
    assert len(shard.extended(none, True).words) == 5 and not len(shard.extended(none, True).size)
