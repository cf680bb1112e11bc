"""Toxicity by a factorization machine over hashed terms (operator 5).

Terms of a text are the hashes of its words and of the words' first 4 to 7 bytes.
The machine scores

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,   x_i = sqrt(min(count, 3) / 3)

so that two terms that are harmless alone can count together. It looks at two kinds of
terms; all others score nothing, so the length of a text does not drown them:

* the ``TERMS`` terms that are most surely commoner in the toxic documents of the sample;
* of the ``CANDIDATES`` commonest others, whichever class they are commoner in and also if
  in none, the ``PARTNERS`` that most surely part the classes *among the documents that hold
  one of the ``HOLDERS`` surest terms of the first kind*, each of these looked at on its own:
  a group mention that is toxic beside an insult, a negation that is not.

Both are counted by Spark, two numbers a term; only the chosen terms' occurrences, at most
``TERMS + PARTNERS`` of each document of the sample, come to the driver.

It is fitted by AdaGrad on at most ``SAMPLE`` labelled documents of each class, those
with the least hash of their id; the classes' weights are those they have among all
labelled documents. Every document is then scored whole.

Defined results: null and empty texts have no terms and score what w0 says; a label
is not learned where it, its id or its document is null or missing; a document with
several label rows is learned by the largest; with one class alone to learn from the
score is its share (0 or 1), with none 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillvault.llm.common import id_and_text, learns, same_hash, written
from tillvault.llm.shingles import flat, term_hashes

SAMPLE = 8000  # labelled documents of each class
TERMS = 4096
PARTNERS = 1024
HOLDERS = 32
CANDIDATES = 16384
SURE = 2  # errors by which a term's log odds have to differ from none
SURE_BESIDE = 5  # the same for partners: so many pairs are tried that chance alone gives some 4
FACTORS = 4
MOST = 3  # occurrences that count
LEAST_DOCUMENTS = 4  # of the toxic documents counted that a term must be in; a partner: of one of the classes
THRESHOLD = 0.7
EPOCHS = 30
BATCH = 256


def counted(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct terms, occurrences) of each text."""
    for terms in term_hashes(*flat(column)):
        yield np.unique(terms, return_counts=True)


@dataclass
class Machine:
    """terms: sorted hashes; w0, w, v: weights. Without terms the score is w0's."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def features(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return at[known], np.sqrt(np.minimum(counts[known], MOST) / MOST).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def sureness() -> Column:
    """Log odds of a term between the classes over their error; more than 0: commoner in toxic documents."""
    t, c = F.col("in_toxic") + 0.5, F.col("in_clean") + 0.5
    odds = F.log(t / (F.col("toxic") - t + 1)) - F.log(c / (F.col("clean") - c + 1))
    return odds / F.sqrt(1 / t + 1 / c)


def _with_totals(parts: DataFrame) -> DataFrame:
    """Sums (holder, term, in_toxic, in_clean); the sums of term -1, documents of each class, become columns."""
    sums = parts.groupBy("holder", "term").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))
    sums = written(sums, "terms")
    every = sums.filter("term = -1").select("holder", F.col("in_toxic").alias("toxic"), F.col("in_clean").alias("clean"))
    # One row a holder: at most HOLDERS.
    return sums.filter("term >= 0").join(F.broadcast(every), "holder")


COUNTS = "holder long, term long, in_toxic long, in_clean long"


def _count_rows(holder: int, terms: np.ndarray, in_toxic: np.ndarray, in_clean: np.ndarray) -> pa.RecordBatch:
    columns = (np.full(len(terms), holder), terms, in_toxic, in_clean)
    names = ["holder", "term", "in_toxic", "in_clean"]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names)


def term_counts(sample: DataFrame) -> DataFrame:
    """(holder, term, in_toxic, in_clean, toxic, clean): how many documents of the sample have each term.

    ``toxic`` and ``clean`` are all that are counted, ``holder`` is -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            found = [np.frombuffer(packed.as_py(), np.uint32) for packed in batch.column(1)]
            for of in np.unique(toxic):
                documents = [f for f, t in zip(found, toxic) if t == of]
                terms, n = np.unique(np.concatenate(documents), return_counts=True)
                # The number of documents goes as the count of term -1.
                terms, n = np.append(terms.astype(np.int64), -1), np.append(n, len(documents))
                yield _count_rows(-1, terms, n * of, n * (1 - of))

    return _with_totals(sample.select("toxic", "terms").mapInArrow(run, COUNTS))


def beside_counts(sample: DataFrame, holders: np.ndarray, candidates: np.ndarray) -> DataFrame:
    """As ``term_counts``, of the ``candidates`` (sorted) among the documents that hold a holder, for each holder.

    A task counts in one table of classes x holders x candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(holders), len(candidates) + 1), np.int32)
        for batch in batches:
            for toxic, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(packed.as_py(), np.uint32)
                held = np.flatnonzero(np.isin(holders, own, assume_unique=True))
                if len(held):
                    there = np.flatnonzero(np.isin(candidates, own, assume_unique=True))
                    n[toxic][np.ix_(held, np.append(there, len(candidates)))] += 1
        names = np.append(candidates.astype(np.int64), -1)
        for i, holder in enumerate(holders.tolist()):
            some = np.flatnonzero(n[:, i].any(axis=0))
            if len(some):
                yield _count_rows(holder, names[some], n[1, i, some], n[0, i, some])

    return _with_totals(sample.select("toxic", "terms").mapInArrow(run, COUNTS))


def chosen_terms(
    sample: DataFrame, most: int = TERMS, partners: int = PARTNERS, holders: int = HOLDERS, candidates: int = CANDIDATES
) -> np.ndarray:
    """The terms that tell toxic documents by themselves, and those that do so beside them; sorted."""

    def best(counts: DataFrame, most: int) -> np.ndarray:
        found = counts.orderBy(F.desc("z"), "term").limit(most).select("term").collect()
        return np.array([r.term for r in found], np.uint32)

    counts = term_counts(sample)
    sure = counts.filter(F.col("in_toxic") >= LEAST_DOCUMENTS).withColumn("z", sureness()).filter(F.col("z") > SURE)
    alone = best(sure, most)
    if not len(alone) or not partners:
        return np.sort(alone)
    common = F.greatest("in_toxic", "in_clean")
    others = counts.filter((common >= LEAST_DOCUMENTS) & ~F.col("term").isin(alone.tolist()))
    others = np.sort(best(others.withColumn("z", common), candidates))
    beside = beside_counts(sample, alone[:holders], others).withColumn("z", F.abs(sureness()))
    beside = beside.groupBy("term").agg(F.max("z").alias("z")).filter(F.col("z") > SURE_BESIDE)
    return np.union1d(alone, best(beside, partners))


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 5,
    terms: np.ndarray | None = None,
) -> Machine:
    """Weighted logistic loss, AdaGrad, small quadratic penalties; the same result for the same rows.

    ``terms``: those it looks at, sorted; without them all that the rows have.
    """
    if terms is None:
        terms = np.unique(np.concatenate([r[0] for r in rows]))
    rng = np.random.default_rng(seed)
    prior = float(np.average(labels, weights=weights))
    m = Machine(
        terms,
        float(np.log(prior / (1 - prior))),
        np.zeros(len(terms), np.float32),
        rng.normal(0, 0.01, (len(terms), FACTORS)).astype(np.float32),
    )
    if not len(terms):
        return m
    xs = [m.features(*r) for r in rows]
    g0, gw, gv = 1.0, np.ones_like(m.w), np.ones_like(m.v)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            sizes = [len(xs[j][0]) for j in part]
            at = np.concatenate([xs[j][0] for j in part])
            x = np.concatenate([xs[j][1] for j in part])
            row = np.repeat(np.arange(len(part)), sizes)
            vx = m.v[at] * x[:, None]
            sums = np.zeros((len(part), FACTORS), np.float32)
            np.add.at(sums, row, vx)
            linear = np.bincount(row, m.w[at] * x, len(part))
            own = np.bincount(row, (vx * vx).sum(axis=1), len(part))
            z = m.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - own)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weights[part] / len(part)
            d0 = slope.sum()
            dw = np.bincount(at, slope[row] * x, len(m.w)) + 1e-5 * m.w
            dv = np.zeros_like(m.v)
            np.add.at(dv, at, (slope[row] * x)[:, None] * (sums[row] - vx))
            dv += 1e-4 * m.v
            g0 += d0 * d0 * 1e4
            gw += dw * dw * 1e4
            gv += dv * dv * 1e4
            m.w0 -= 30 * d0 / np.sqrt(g0)
            m.w -= (30 * dw / np.sqrt(gw)).astype(np.float32)
            m.v -= (10 * dv / np.sqrt(gv)).astype(np.float32)
    return m


def sampled(texts: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, terms, counts) of the sample, as a table; and how many labels each class has."""
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / sizes.get(1, 1))).otherwise(min(1.0, sample / sizes.get(0, 1)))
    # At most about 2 * sample rows of (id, label): small by construction, so its side may be broadcast.
    few = F.broadcast(labels.filter(same_hash(F.col("doc_id"), 5) < rate))
    rows = texts.join(few, "doc_id").select("doc_id", "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                yield _packed(batch.column(0), batch.column(2), counted(batch.column(1)))

    return written(rows.mapInArrow(run, "doc_id long, toxic int, terms binary, counts binary"), "labelled"), sizes


def _packed(ids: pa.Array, toxic: pa.Array, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            toxic,
            pa.array([t.tobytes() for t, _ in found], pa.binary()),
            pa.array([np.minimum(n, MOST).astype(np.uint8).tobytes() for _, n in found], pa.binary()),
        ],
        ["doc_id", "toxic", "terms", "counts"],
    )


def _unpacked(terms: pa.Array, counts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(t.as_py(), np.uint32), np.frombuffer(n.as_py(), np.uint8)) for t, n in zip(terms, counts)]


def kept_terms(sample: DataFrame, terms: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The chosen terms of each document of the sample, and the labels, in an order of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _unpacked(batch.column(2), batch.column(3))
            known = [np.isin(t, terms, assume_unique=True) for t, _ in found]
            yield _packed(batch.column(0), batch.column(1), ((t[k], n[k]) for (t, n), k in zip(found, known)))

    got = sample.mapInArrow(run, sample.schema).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("terms", "ascending"), ("counts", "ascending")])
    return _unpacked(got.column("terms"), got.column("counts")), got.column("toxic").to_numpy().astype(np.float64)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Machine | float:
    """A machine; or the score of everything where there are not two classes to learn from."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    known = known.filter(learns(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    table, sizes = sampled(id_and_text(docs, id_col, text_col), known, sample)
    per_class = {r.toxic: r["count"] for r in table.groupBy("toxic").count().collect()}
    if len(per_class) < 2:
        return float(max(per_class, default=0))
    terms = chosen_terms(table)
    rows, toxic = kept_terms(table, terms)
    weight = {k: sizes[k] / sum(sizes.values()) * len(toxic) / per_class[k] for k in (0, 1)}
    return train(rows, toxic, np.where(toxic == 1, weight[1], weight[0]), terms=terms)


def score(texts: DataFrame, model: Machine | float) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                if isinstance(model, float):
                    scores = [model] * batch.num_rows
                else:
                    raw = [model.raw(*model.features(*found)) for found in counted(batch.column(1))]
                    scores = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, id_col, text_col)
    out = score(id_and_text(docs, id_col, text_col), model)
    return out.select(
        "doc_id",
        (~learns(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
