"""Language identification by nearest centroids of TF-IDF n-gram vectors (operator 6).

A text is the vector of its hashed byte trigrams: (1 + log tf) * idf, scaled to
length 1. The idf counts every document that may be learned from. Each language has
several centroids, found by spherical k-means on at most ``SAMPLE`` of its documents
(those with the least hash of their id). A text goes to the language of the centroid
of largest cosine; its score is that cosine. It is rejected if it has no letter, or
if its cosine is under that of nearly all (1 - ``LOSS``) of the language's sampled
documents of its length. Those are measured against centroids fitted without them, so
about that share of documents not learned from is lost too.

Short texts have few trigrams: documents of a language have cosines as low as a short
text of a neighbouring language, so of those some stay.

Defined results: ``und`` with score 0 and rejected where the text is null, empty or
has no letter; ``und`` with score 0 where nothing could be learned; rows that repeat are predicted each;
rows with a null language or id are not learned from; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillvault.llm.common import learns, same_hash
from tillvault.llm.shingles import flat

DIMENSIONS = 1 << 12
SAMPLE = 1000  # documents of each language that the centroids are fitted on
CENTROIDS = 3
ROUNDS = 8
SEGMENT = 1 << 20
LOSS = 0.005  # share of a language's own documents that its bound rejects
FOLDS = 4
FEW = 20  # texts that a bound needs; a length class with fewer takes in those next to it
LENGTHS = (8, 32, 128, 512)  # bounds of the length classes, in trigrams
UNKNOWN = "und"

# ASCII letters are lower-cased; other ASCII bytes part words; the bytes of other letters stay.
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_MAY_BE = re.compile(r"[^\W\d_]")  # letters, but also fractions, circled and Roman numbers


def has_letter(text: str) -> bool:
    """Whether a character of the text is of a Unicode category L."""
    return any(found.group().isalpha() for found in _MAY_BE.finditer(text))


def trigram_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts (texts x DIMENSIONS) of the hashed byte trigrams of each text."""
    out = np.zeros((len(ends) - 1, DIMENSIONS), np.float32)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        for at in range(a, b - 2, SEGMENT):
            c = _CLASS[data[at : min(at + SEGMENT + 2, b)]]
            code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
            code = code[code != 0x202020] * np.uint32(2654435761) >> np.uint32(20)
            out[i] += np.bincount(code, minlength=DIMENSIONS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    length = np.sqrt(np.einsum("ij,ij->i", weighted, weighted))[:, None]
    return weighted / np.maximum(length, 1e-9)


@dataclass
class Model:
    """centroids: unit vectors; of: each one's language; least: bounds by (language, length class)."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, beyond that language's distance) of each row."""
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(best)), best]
        language = self.of[best]
        return language, top, top < self.least[language, length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LENGTHS), counts.sum(axis=1))


def left_out_cosines(rows: np.ndarray, k: int) -> np.ndarray:
    """The largest cosine of each row with centroids fitted on the rows of the other folds."""
    fold, out = np.arange(len(rows)) % FOLDS, np.ones(len(rows))
    for f in range(FOLDS):
        if (fold == f).any() and (fold != f).any():
            out[fold == f] = (rows[fold == f] @ k_means(rows[fold != f], k).T).max(axis=1)
    return out


def bounds(cosines: list[np.ndarray], kinds: list[np.ndarray]) -> np.ndarray:
    """The bound of each (language, length class), from the sample's left-out cosines and classes.

    Where a language has too few texts of all lengths, those of all languages count; 0 where these are too few.
    """
    out = np.zeros((len(cosines), len(LENGTHS) + 1), np.float32)
    everything = np.concatenate(cosines), np.concatenate(kinds)
    for i, own in enumerate(zip(cosines, kinds)):
        cosine, kind = own if len(own[0]) >= FEW else everything
        for c in range(out.shape[1]):
            pools = (cosine[np.abs(kind - c) <= reach] for reach in range(out.shape[1]))
            near = next((p for p in pools if len(p) >= FEW), None)
            out[i, c] = 0 if near is None else np.quantile(near, LOSS)
    return out


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from spread starting rows; at most as many centroids as distinct rows."""
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < k and nearest.min() < 0.999:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        of = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack([rows[of == c].sum(axis=0) if (of == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids.astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(number of texts, number of those that have each dimension): one row per task and dimension is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            counts = trigram_counts(*flat(batch.column(0)))
            total[:-1] += (counts > 0).sum(axis=0)
            total[-1] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS + 1), pa.int32()), pa.array(total)], ["d", "n"])

    rows = texts.select("text").mapInArrow(run, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMENSIONS + 1, np.int64)
    for row in rows:
        df[row.d] = row.n
    return int(df[-1]), df[:-1]


def sampled_counts(labelled: DataFrame, sample: int) -> dict[str, np.ndarray]:
    """The counts of at most about ``sample`` texts of each language."""
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    rows = labelled.filter(same_hash(F.col("doc_id"), 6) < F.element_at(share, F.col("lang"))) if sizes else labelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.minimum(trigram_counts(*flat(batch.column(0))), 65535).astype(np.uint16)
            kept = [np.flatnonzero(row).astype(np.uint16) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([k.tobytes() for k in kept], pa.binary()),
                    pa.array([row[k].tobytes() for row, k in zip(counts, kept)], pa.binary()),
                ],
                ["lang", "at", "n"],
            )

    found: dict[str, list] = {}
    for row in rows.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect():
        found.setdefault(row.lang, []).append((row.at, row.n))
    out = {}
    for lang in sorted(found):
        # A fixed order, whatever order the rows come in.
        counts = np.zeros((len(found[lang]), DIMENSIONS), np.float32)
        for i, (at, n) in enumerate(sorted(found[lang])):
            counts[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint16)
        out[lang] = counts
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Learns from (doc_id, text, lang); None where there is nothing to learn from."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    n, df = document_frequencies(labelled)
    counts = sampled_counts(labelled, sample)
    if not counts:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    found, of, cosines, kinds = [], [], [], []
    for i, rows in enumerate(counts.values()):
        unit = vectors(rows, idf)
        own = k_means(unit, centroids)
        found.append(own)
        of += [i] * len(own)
        cosines.append(left_out_cosines(unit, centroids))
        kinds.append(length_class(rows))
    return Model(list(counts), idf, np.concatenate(found), np.array(of), bounds(cosines, kinds))


def predictor(model: Model | None, texts_at: int, width: int):
    """Adds (lang_pred, score, rejected) to batches of ``width`` columns, by the text in column ``texts_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(texts_at).fill_null("")
                lettered = np.array([has_letter(t.as_py()) for t in texts], bool)
                n = len(lettered)
                names, scores, rejected = [UNKNOWN] * n, np.zeros(n), ~lettered
                if model is not None and n:
                    language, cosine, far = model.nearest(trigram_counts(*flat(texts)))
                    names = [model.languages[k] if letter else UNKNOWN for k, letter in zip(language, lettered)]
                    scores = np.where(lettered, np.clip(cosine, 0, 1), 0).astype(np.float64)
                    rejected |= far
                out = [pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in range(width)), *out],
                    [*(f"c{k}" for k in range(width)), "lang_pred", "score", "rejected"],
                )

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and (lang_pred, score, rejected)."""
    at = [f.name for f in docs.schema].index(text_col)
    # Places, not names, so that any name may occur among the columns.
    places = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    added = T.StructType(
        [
            *places.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return places.mapInArrow(predictor(model, at, len(docs.columns)), added)


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return rows.filter(learns(F.col("doc_id")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row."""
    model = fit(learnable(docs, id_col, text_col, lang_col))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    out = predict(rows, model).withColumnsRenamed({"c0": "doc_id"})
    return out.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
