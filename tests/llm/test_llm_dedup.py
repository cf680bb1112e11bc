"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import differences
from llm_edges import SF_DIR, edge, empty, pairs  # noqa: F401

from tillvault.llm import components, exact, minhash, passages, queries, shingles, suffixes


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_sql(spark, db, name):
    assert differences(spark, db, queries.queries()[name], queries.oracles()[name], SF_DIR) is None


# --- exact ------------------------------------------------------------------------


def brute_exact(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("huge", [exact.HUGE, 50])
def test_exact_groups(edge, empty, pairs, huge):
    assert Counter(map(tuple, exact.exact_groups(edge, huge=huge).collect())) == brute_exact(pairs)
    assert exact.exact_groups(empty).isEmpty()


def test_a_full_bitmap_only_costs_work(edge, pairs):
    assert Counter(map(tuple, exact.exact_groups(edge, bits=1).collect())) == brute_exact(pairs)


def test_fingerprints_combine(spark, edge):
    h, rng = exact.Polynomial(), np.random.default_rng(1)
    x, y = (rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (40_000, 21_345))
    for k in (0, 1):
        shift = pow(exact.BASES[k], len(y), exact.PRIMES[k])
        whole = (h.of(memoryview(x))[k] * shift + h.of(memoryview(y))[k]) % exact.PRIMES[k]
        assert h.of(memoryview(x + y))[k] == whole
        direct = 0
        for b in y:
            direct = (direct * exact.BASES[k] + b) % exact.PRIMES[k]
        assert h.of(memoryview(y))[k] == direct
    texts = exact.id_and_text(edge)
    apart, at_once = exact.fingerprints(texts, huge=10, segment=7), exact.fingerprints(texts)
    assert apart.exceptAll(at_once).isEmpty() and at_once.exceptAll(apart).isEmpty()


def test_texts_of_equal_fingerprints_are_told_apart(spark):
    a, b = b"a" * 200, b"a" * 199 + b"b"
    sha = {t: hashlib.sha256(t).hexdigest() for t in (a, b)}
    rows = [(1, a), (2, a), (3, b), (4, b), (5, b)]
    df = spark.createDataFrame(
        [(i, 200, 7, 7, sha[t], sha[t], bytearray(t)) for i, t in rows],
        "doc_id long, n_bytes long, h1 long, h2 long, sha string, leader string, text binary",
    )
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.groups_of(df).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (5, 3), 4: (5, 3), 5: (5, 3)}


# --- near -------------------------------------------------------------------------

_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(_LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(pairs):
    sets = [shingle_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(pairs):
        if sets[k] and i is not None:
            least[find(k)].append(i)
    out = Counter()
    for k, (i, _) in enumerate(pairs):
        component = min(least[find(k)], default=None) if sets[k] else i
        out[i, len(sets[k]), component, i == component] += 1
    return out


def test_near_duplicates(edge, empty, pairs):
    got = minhash.near_duplicates(edge).drop("text_md5").collect()
    assert Counter(map(tuple, got)) == brute_near(pairs)
    assert minhash.near_duplicates(empty).isEmpty()


def test_copies_around_the_threshold(spark):
    """A group whose members differ from their middle by all degrees: every link counts."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    pairs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = f"e{rng.randint(0, 30)}"
        pairs.append((i, " ".join(w)))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, minhash.near_duplicates(df).drop("text_md5").collect())) == brute_near(pairs)


@pytest.mark.parametrize("n", [1, 2, 17, 5000])
def test_every_coordinate_fills(n):
    rng, sketcher = np.random.default_rng(n), minhash.Sketcher()
    one = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    assert (sketcher.of(one) != np.iinfo(np.uint64).max).all()
    if n > 1000:
        other = np.append(one[: n * 6 // 7], rng.integers(0, 1 << 64, n // 7, dtype=np.uint64))
        alike = (sketcher.of(one) == sketcher.of(other)).mean()
        assert abs(alike - 0.75) < 0.15


def test_shingles_do_not_depend_on_segments(monkeypatch, pairs):
    texts = [t.encode() for _, t in pairs]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = list(shingles.shingle_sets(data, ends))
    terms = [np.sort(t) for t in shingles.term_hashes(data, ends)]
    monkeypatch.setattr(shingles, "SEGMENT", 100)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_sets(data, ends), strict=True))
    assert all((a == np.sort(b)).all() for a, b in zip(terms, shingles.term_hashes(data, ends), strict=True))
    assert [len(s) for s in whole] == [len(shingle_set(t)) for _, t in pairs]


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{rng.randint(0, 80):03}", f"{rng.randint(0, 80):03}") for _ in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(10, 40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# --- strings and lines ------------------------------------------------------------


def brute_strings(pairs, size=200):
    texts = [t.encode() for _, t in pairs]
    seen = Counter(t[k : k + size] for t in texts for k in range(len(t) - size + 1))
    out = Counter()
    for (i, _), t in zip(pairs, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_strings(spark, edge, empty, pairs):
    small = [(i, t) for i, t in pairs if len(t) < 50_000]
    df = edge.filter("text IS NULL OR length(text) < 50000")
    got = suffixes.without_repeats(df, with_text=True).collect()
    assert Counter(tuple(r[:5]) for r in got) == brute_strings(small)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans for r in got)
    assert suffixes.without_repeats(empty).isEmpty()
    # One letter 100,000 times, and a text without repeats beside it.
    rest = {r.doc_id: r for r in suffixes.without_repeats(edge).filter("doc_id IN (12, 13)").collect()}
    assert rest[13].n_removed == 100_000 and rest[13].n_spans == 1 and rest[12].n_removed == 0


def test_passages_of_every_offset(spark):
    """Shared passages of 199 to 460 bytes, at places of all remainders."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = [letters(n) for n in (199, 200, 201, 230, 333, 460)]
    pairs = [(i, letters(rng.randint(0, 150)) + rng.choice(shared) + letters(rng.randint(0, 300))) for i in range(120)]
    got = suffixes.without_repeats(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r[:5]) for r in got) == brute_strings(pairs)


def test_difference_cover():
    v, places = suffixes.difference_cover(suffixes.ORDER)
    assert v == 133 and len(places) == 12
    assert {(a - b) % v for a in places for b in places} == set(range(v))


def brute_units(pairs, least=passages.LEAST):
    order = sorted({(i is None, i or 0, passages._key(i, t.encode()), t) for i, t in pairs})
    units = {}
    for rank, (_, _, key, t) in enumerate(order):
        own, at = units.setdefault(key, []), 0
        for line in t.split("\n"):
            said = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line.translate(_LOWER)))
            if said:
                own.append((passages.LINE, said, at, min(at + len(line) + 1, len(t))))
            at += len(line) + 1
        words = [(m.start(), m.end(), m.group().translate(_LOWER)) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        ends = [k for k, w in enumerate(words) if w[2][-1] in ".!?" or k == len(words) - 1]
        begins = [0, *(k + 1 for k in ends[:-1])]
        for begin in begins:
            for end in (e for e in ends if e >= begin):
                run = words[begin : end + 1]
                if sum(b - a for a, b, _ in run) >= least:
                    own.append((passages.PARAGRAPH, " ".join(w for _, _, w in run), run[0][0], [*words, (len(t),)][end + 1][0]))
                    break
    first = {}
    for rank, (_, _, key, _) in enumerate(order):
        for kind, said, start, _ in sorted(units[key], key=lambda u: u[2]):
            first.setdefault((kind, said), (key, start))
    out = Counter()
    for i, t in pairs:
        key = passages._key(i, t.encode())
        gone = {u for u in units[key] if first[u[:2]] != (key, u[2])}
        left = list(t)
        marks = [0] * (len(t) + 1)
        for _, _, a, b in gone:
            for k in range(a, b):
                left[k] = ""
                marks[k] = 1
        runs = sum(a == 0 and b == 1 for a, b in zip([0, *marks], marks))
        kept = "".join(left)
        lines = sum(u[0] == passages.LINE for u in gone)
        out[i, runs, lines, len(t), len(kept), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def counted_units(rows):
    return Counter((r[0], r[1], r[2], r[4], r[5], r[6]) for r in rows)


@pytest.mark.parametrize(("least", "bits", "share"), [(passages.LEAST, passages.BITMAP_BITS, passages.SHARE), (20, 6, 5)])
def test_repeated_units(edge, empty, pairs, least, bits, share):
    got = passages.without_repeats(edge, least=least, bits=bits, share=share).collect()
    assert counted_units(got) == brute_units(pairs, least)
    assert {len(r.spans) for r in got} > {0}
    for row, text in ((r, dict(pairs)[r.doc_id]) for r in got if r.doc_id in (9, 16, 17)):
        kept, at = "", 0
        for span in row.spans:
            kept, at = kept + text[at : span.start], span.start + span.length
        assert kept + text[at:] == row.kept_text and row.n_removed == len(row.spans)
    assert passages.without_repeats(empty).isEmpty()


def test_passages_inside_lines_and_wrapped_differently(spark):
    """A passage of over 50 words is found whatever stands around it and wherever its lines break."""
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"own{rng.randint(0, 10**9)}" for _ in range(n))
    said = [f"Said {fresh(rng.randint(4, 11))}." for _ in range(8)]
    passage = " ".join(said)
    wrap = lambda width: re.sub(f"((?:\\S+ ){{{width}}})", "\\1\n", passage)
    texts = [f"{fresh(30)}. {passage} {fresh(30)}", f"{fresh(9)} {passage.upper()} {fresh(9)}", wrap(8), f"{fresh(3)}.\n{wrap(5)}\n{fresh(3)}"]
    clean = [f"{fresh(40)}. Yes. {fresh(40)}. Yes. No." for _ in range(4)]
    rows = list(enumerate(texts + clean))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.without_repeats(df).collect()
    assert counted_units(got) == brute_units(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_passages == 0 and all(by_id[i].n_passages == 1 for i in (1, 2, 3))
    assert all(len(re.findall("own", by_id[i].kept_text, re.I)) < len(re.findall("own", texts[i], re.I)) - 30 for i in (1, 2, 3))
    assert all(by_id[i].n_removed == 0 for i in range(4, 8))


def test_short_lines_are_units(spark):
    rows = [(1, "Fin\nA  short line\nalone"), (2, "a short\tline\nother"), (3, "\n\nA short line"), (4, "\n\n x")]
    got = {r.doc_id: r.kept_text for r in passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other", 3: "\n\n", 4: "\n\n x"}
