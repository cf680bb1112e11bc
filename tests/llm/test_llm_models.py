"""Toxicity, language, WARC, mixing, fingerprints and the pipeline."""

import hashlib
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from llm_edges import SF_DIR, edge, empty, pairs  # noqa: F401
from pyspark.sql import functions as F
from test_llm_dedup import brute_near

import corpus_pipeline
from tillvault.llm import ctph, langid, mixing, queries, toxicity, warc
from tillvault.llm.common import learns, learns_id

SF = "/root/testdata/sf0.01"


# --- classifiers ------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    got = queries.op5_toxicity(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(r.held_out == (not learns_id(i)) and 0 <= r.score <= 1 for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if not learns_id(r.doc_id)]
    right = Counter((r.toxic, rows[r.doc_id].predicted) for r in labels if r.doc_id in rows)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.5 and right[0, 1] <= 0.02 * right[0, 0]


def test_toxicity_edge_cases(spark, edge, empty):
    labels = spark.createDataFrame(
        [(0, 1), (0, 0), (1, 0), (2, None), (None, 1), (20, 1), (99, 1)], "doc_id long, toxic int"
    ).withColumn("text", F.lit("clash"))
    rows = toxicity.toxicity(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, labels).isEmpty()
    assert {r.score for r in toxicity.toxicity(edge, labels.limit(0)).collect()} == {0.0}


def test_pairs_count_beyond_their_terms():
    """Two terms that are clean alone and toxic together: what a linear score cannot learn."""
    rng = np.random.default_rng(2)
    a, b = np.uint32(10), np.uint32(20)
    rows, labels = [], []
    for _ in range(3000):
        own = [x for x in (a, b) if rng.random() < 0.5]
        terms = np.array(sorted([*own, *rng.integers(100, 130, 5)]), np.uint32)
        rows.append(np.unique(terms, return_counts=True))
        labels.append(float(len(own) == 2))
    m = toxicity.train(rows, np.array(labels), np.ones(len(rows)))
    one = np.ones(1, int)
    score = lambda *t: m.raw(*m.features(np.array(t, np.uint32), np.ones(len(t), int)))
    assert score(a, b) > 0 > max(score(a), score(b), score())
    assert score(a, b) - score(a) - score(b) + score() > 1 and len(one) == 1


def test_a_neutral_term_counts_beside_another(spark):
    """'gruppe' is in as many clean as toxic documents; what it is worth depends on its neighbour."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        insult, other, group = (bool(rng.random() < 0.4) for _ in range(3))
        toxic = (insult and group) or (other and not group)
        words = [w for w, there in (("trottel", insult), ("fiesling", other), ("gruppe", group)) if there]
        words += [f"wort{n}" for n in rng.integers(0, 40, 8)]
        rows.append((i, " ".join(rng.permutation(words)), int(toxic), insult, other, group))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, insult boolean, other boolean, has_group boolean")
    neutral = docs.groupBy("toxic").agg(F.avg(F.col("has_group").cast("int")).alias("share")).collect()
    assert abs(neutral[0].share - neutral[1].share) < 0.1
    table, _ = toxicity.sampled(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), 5000)
    mention = set(next(toxicity.counted(pa.array(["gruppe"])))[0].tolist())
    assert not mention & set(toxicity.chosen_terms(table, partners=0).tolist())
    assert mention & set(toxicity.chosen_terms(table).tolist())
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, docs).collect()}
    mean = lambda rule: np.mean([got[r[0]] for r in rows if not learns_id(r[0]) and rule(*r[3:])])
    assert mean(lambda i, o, g: i and not o and g) > 0.8 > 0.2 > mean(lambda i, o, g: i and not o and not g)
    assert mean(lambda i, o, g: o and not i and not g) > 0.8 > 0.2 > mean(lambda i, o, g: o and not i and g)


def test_terms_are_chosen_by_their_counts(spark):
    """Counts and choice against counting in the driver, with and without a condition."""
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.random() < 0.3)) for i in range(400)]
    rows = [(i, t, np.unique(np.append(rng.integers(0, 50, 6), [60] if t and rng.random() < 0.5 else [])).astype(np.uint32)) for i, t in rows]
    table = spark.createDataFrame(
        [(i, t, f.tobytes(), bytes(len(f))) for i, t, f in rows], "doc_id long, toxic int, terms binary, counts binary"
    )
    candidates = np.array([3, 7, 20, 21, 60, 98], np.uint32)
    every_term = set(range(50)) | {60}
    for counts, holders, terms in (
        (toxicity.term_counts(table), [-1], every_term),
        (toxicity.beside_counts(table, np.array([60, 3, 99], np.uint32), candidates), [60, 3], set(candidates.tolist())),
    ):
        want = {}
        for holder in holders:
            seen = [(t, set(f.tolist())) for _, t, f in rows if holder == -1 or holder in f]
            every = (sum(t for t, _ in seen), sum(1 - t for t, _ in seen))
            for term in terms & set().union(*(f for _, f in seen)):
                held = [t for t, f in seen if term in f]
                want[holder, term] = (sum(held), len(held) - sum(held), *every)
        got = counts.collect()
        assert {(r.holder, r.term): (r.in_toxic, r.in_clean, r.toxic, r.clean) for r in got} == want and len(got) == len(want)
    assert 60 in toxicity.chosen_terms(table) and len(toxicity.chosen_terms(table, most=1, partners=0)) == 1


def test_language_on_held_out_documents(spark):
    rows = queries.op6_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (not learns_id(r.doc_id)) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_language_edge_cases(spark, edge, empty):
    got = {r.doc_id: r for r in langid.identify(edge).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 11)] == ["und"] * 4 and got[11].score == 0 and got[11].rejected
    assert got[0].lang_pred in ("en", "de") and got[18].lang_pred in ("en", "de")
    assert langid.identify(empty).isEmpty()
    nothing = langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    strange = spark.createDataFrame([("Зимой снег лежит на полях и в лесах. " * 20,), (docs.first().text,)], "text string")
    assert [r.rejected for r in langid.predict(strange.coalesce(1), model).collect()] == [True, False]


NEIGHBOURS = {
    "it": "Il sole era già alto quando la famiglia decise di partire verso la montagna con tutti i bambini e il cane. Durante il viaggio parlarono della scuola, del lavoro e delle prossime vacanze, mentre la strada saliva lentamente tra i boschi e le piccole case di pietra.",
    "pt": "O sol já estava alto quando a família decidiu partir para a montanha com todas as crianças e o cão. Durante a viagem falaram da escola, do trabalho e das próximas férias, enquanto a estrada subia devagar entre os bosques e as pequenas casas de pedra.",
    "nl": "De zon stond al hoog toen het gezin besloot om met alle kinderen en de hond naar de bergen te vertrekken. Tijdens de reis spraken zij over de school, het werk en de volgende vakantie, terwijl de weg langzaam omhoog liep tussen de bossen en de huizen.",
    "code": "def read_rows(path, limit=10):\n    rows = []\n    with open(path) as handle:\n        for number, line in enumerate(handle):\n            if number >= limit:\n                break\n            rows.append(line.rstrip().split(','))\n    return {key: value for key, value in rows}\n",
}


def test_neighbouring_languages_and_code_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    foreign = [t * n for t in NEIGHBOURS.values() for n in (1, 8)] + [NEIGHBOURS["code"][:25]]
    rows = spark.createDataFrame([(t,) for t in foreign], "text string").coalesce(1)
    assert all(r.rejected for r in langid.predict(rows, model).collect())
    # What of the documents that were not learned from is lost.
    held = langid.predict(docs.filter(~learns(F.col("doc_id"))).select("text"), model)
    assert held.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.01


# --- WARC -------------------------------------------------------------------------


def page_rows():
    long = "<p>" + "x" * 200
    return [(1, "u1", long), (2, "u\r\n2", long), (3, None, long), (4, "u", None), (5, "u", "a" * 99), (6, "u", "a" * 99),
            (None, "u", long), (7, "u", "\r\n\r\n" * 40), (8, "u", "é" * 400_000), (8, "u", "é" * 400_000), (9, "u", "é" * 400_000)]


def test_archive_edge_cases(spark):
    schema = "page_id long, url string, html string, digest string, refers_to long, data string"
    pages = spark.createDataFrame([(*r, "d", 1, "x") for r in page_rows()], schema).repartition(3)
    got = Counter(tuple(r)[:5] for r in warc.archive(pages).collect())
    least = {}
    for i, _, h in page_rows():
        if i is not None:
            least[h] = min(i, least.get(h, i))
    wanted = Counter()
    for i, _, h in page_rows():
        data = (h or "").encode()
        refers = least[h] if len(data) >= 100 and i != least[h] else None
        wanted[i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    assert got == wanted
    assert warc.archive(pages.limit(0)).isEmpty()


def test_bundles_are_seekable(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    bundles = warc.write_bundles(pages).cache()
    some = pages.filter("page_id % 7 = 3")
    html = {r.page_id: r.html.encode() for r in some.collect()}
    read = {r.page_id: bytes(r.record) for r in warc.read_at(bundles, some).collect()}
    assert read.keys() == html.keys()
    for page, record in read.items():
        _, n, digest, kind, *_ = next(warc.parse(record))
        assert n == len(html[page]) and digest == hashlib.sha256(html[page]).hexdigest()
        assert kind == "revisit" or html[page] in record
    written = warc.export(bundles, str(tmp_path)).collect()
    for r in written:
        data = (tmp_path / f"{r.bundle}.warc.zst").read_bytes()
        assert len(data) == r.bytes and struct.unpack("<I", data[-4:])[0] == warc.SEEKABLE_MAGIC
        # Any reader that passes over skippable frames reads the same from the start.
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(warc.frame_of(data, k) for k in range(len(warc.seek_table(data))))
    with pytest.raises(ValueError):
        warc.seek_table(b"x" * 100)


# --- mixing -----------------------------------------------------------------------


def test_raked_shares_hold(spark):
    df = mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet"), mixing.Targets(lang={"en": 0.4, "de": 0.3, "(other)": 0.3}))
    rows = df.collect()
    total = sum(r.tokens for r in rows)
    weighted = Counter()
    for r in rows:
        for d in mixing.DIMENSIONS:
            weighted[d, r[d]] += r.tokens * r.weight / total
    assert abs(weighted["lang", "en"] - 0.4) < 1e-4 and abs(weighted["lang", "de"] - 0.3) < 1e-4
    own = Counter()
    for r in rows:
        own[r.source] += r.tokens
    goal = mixing.shares(own, None, 0.5)
    assert all(abs(weighted["source", s] - g) < 1e-4 for s, g in goal.items())
    # Kept tokens: as expected, and each row by its own number alone.
    assert abs(sum(r.tokens * r.probability for r in rows) / total - 0.9) < 1e-6
    assert abs(sum(r.tokens for r in rows if r.kept) / total - 0.9) < 0.05
    for r in rows:
        drawn = int(hashlib.md5(f"{r.doc_id}:8".encode()).hexdigest()[:12], 16) / 2**48
        assert r.kept == (drawn < r.probability) and list(r.row.asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_copies_reach_the_targets(spark):
    rows = mixing.mixed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).drop("row").collect()
    mixed = sum(r.tokens * r.copies for r in rows)
    for name in mixing.DIMENSIONS:
        own, got = Counter(), Counter()
        for r in rows:
            own[r[name]] += r.tokens
            got[r[name]] += r.tokens * r.copies / mixed
        goal = mixing.shares(own, None, mixing.Targets().temperature[name])
        assert all(abs(got[v] - share) < 0.01 for v, share in goal.items()), name
    assert all(r.kept == (r.copies > 0) for r in rows)


def test_many_cells_are_raked_alike(spark, edge):
    for targets in (mixing.Targets(), mixing.Targets(source={"a": 0.5, "b": 0.2}, lang={"en": 1.0, "(other)": 1.0})):
        few = {r.doc_id: r.probability for r in mixing.mixed(edge, targets).collect()}
        many = {r.doc_id: r.probability for r in mixing.mixed(edge, targets, most_cells=2).collect()}
        assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-6 for k in few)


def test_targets_that_cannot_be_met_say_so(spark):
    """All of a source's tokens are of one language, but the targets want other shares of the two."""
    rows = [(i, "word " * 50, "en" if i % 2 else "de", "a" if i % 2 else "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bad = mixing.Targets(source={"a": 0.9, "b": 0.1}, lang={"en": 0.1, "de": 0.9})
    for most in (100, 1):
        assert {r.gap > 0.1 for r in mixing.mixed(df, bad, most_cells=most).collect()} == {True}
        assert {r.gap < mixing.CLOSE for r in mixing.mixed(df, most_cells=most).collect()} == {True}


def test_tokens_of_texts_without_spaces(spark):
    texts = ["one two", "a\tb\nc", "漢" * 80, "", " ", None, "x" * 17]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.token_count(df.t)).collect()] == [2, 3, 10, 0, 0, 0, 3]


def test_mixing_edge_cases(edge, empty):
    rows = mixing.mixed(edge).collect()
    assert len(rows) == edge.count() and {r.source for r in rows} == {"(none)", "a", "b"}
    assert all(r.tokens == 0 for r in rows if not r.row.text)
    assert mixing.mixed(empty).isEmpty()


# --- fingerprints -----------------------------------------------------------------


def test_fingerprints_edge_cases(edge, empty, pairs):
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    wanted = Counter()
    for k, (i, t) in enumerate(order):
        changed = ctph.edited(t, order[(k + 1) % len(order)][1])
        wanted[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), ctph.fingerprint(t), ctph.fingerprint(changed)] += 1
    got = ctph.with_edits(edge).collect()
    assert Counter(tuple(r)[:5] for r in got) == wanted
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    plain = Counter(map(tuple, ctph.fingerprints(edge).collect()))
    assert plain == Counter((i, len(t), ctph.fingerprint(t)) for i, t in pairs)
    assert ctph.with_edits(empty).isEmpty()
    alone = ctph.with_edits(edge.filter("doc_id = 0")).first()
    assert alone.near_next == 1.0


def test_likeness_falls_with_edits(spark):
    rows = queries.op9_ctph(spark, SF_DIR).filter("n_chars > 500")
    mean = rows.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert 0.3 < mean[0] < 0.8 and mean[1] < 0.1


def test_long_texts_by_segments(monkeypatch):
    text = "".join(chr(97 + int(x)) for x in np.random.default_rng(3).integers(0, 26, 20_000))
    whole = ctph.fingerprint(text)
    monkeypatch.setattr(ctph, "SEGMENT", 997)
    assert ctph.fingerprint(text) == whole
    block, one, two = whole.split(":")
    assert int(block) * 64 <= 2 * 20_000 and 31 <= len(one) <= 64 and len(two) <= 32


# --- pipeline ---------------------------------------------------------------------


def brute_kept(spark, docs):
    """(doc_id, text) that reach the packing stage, by plain loops; the model and the rates are the stages' own."""
    schema = docs.schema
    rows = docs.collect()
    model = langid.fit(langid.learnable(docs))
    places = langid.predict(docs.select("doc_id", "text"), model).collect()
    rejected = {(r.c0, r.c1) for r in places if r.rejected}
    rows = [r for r in rows if (r.doc_id, r.text) not in rejected]
    best = {}
    for r in rows:
        t = r.text or ""
        if t not in best or (best[t].doc_id is None) or (r.doc_id is not None and r.doc_id > best[t].doc_id):
            best[t] = r
    rows = list(best.values())
    near = brute_near([(r.doc_id, r.text or "") for r in rows])
    stays = {k[0] for k in near if k[3]}
    rows = [r for r in rows if r.doc_id in stays]
    mixed = mixing.mixed(spark.createDataFrame(rows, schema)).filter("kept").collect()
    return Counter(r.doc_id for r in mixed)


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_pipeline(spark, edge, table, tmp_path):
    docs = edge.filter("doc_id IS NOT NULL") if table == "edge" else spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    per_doc = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("tokens")).collect()
    assert Counter(r.doc_id for r in per_doc) == brute_kept(spark, docs)
    assert all(r.n == r.tokens for r in per_doc)


def test_near_copies_with_null_or_equal_ids(spark):
    text = lambda group, change: " ".join(f"w{group}x{k if k != change else -k}" for k in range(120))
    rows = [(None, text(1, k)) for k in (0, 10, 20)] + [(7, text(2, k)) for k in (0, 10, 20)]
    rows += [(None, text(3, 0)), (9, text(3, 10)), (8, text(3, 20)), (7, text(4, 0)), (None, "short"), (None, "brief")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.near(spark, docs, "").collect()
    first = lambda group: min((text(group, k) for k in (0, 10, 20)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    wanted = [(None, first(1)), (7, first(2)), (8, text(3, 20)), (7, text(4, 0)), (None, "short"), (None, "brief")]
    assert Counter(map(tuple, left)) == Counter(wanted)


def test_stages_hand_on_all_columns(spark, edge, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, "")
        assert out.columns == edge.columns and not out.isEmpty(), name
        assert out.exceptAll(edge).isEmpty(), name
        assert stage(spark, empty, "").isEmpty()
    once = corpus_pipeline.exact_stage(spark, edge, "").filter("doc_id = 15")
    assert once.count() == 1


def test_numbers_are_no_letters():
    assert not any(map(langid.has_letter, ("½", "²", "①", "Ⅷ", "12 _ .", "", "\u0301")))
    assert all(map(langid.has_letter, ("a", "½ é", "漢", "ª", "² ß")))
