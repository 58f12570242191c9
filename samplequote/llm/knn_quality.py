"""Operator 9: quality by votes of the nearest labelled documents.

A text becomes weighted counts in two blocks of hashed terms: its words, and its
forms (shapes of words, with letters' case, digits and signs kept; pairs of
neighbouring shapes; words repeated from the one before; distinct words; lines; bits
of its length). Each block is weighted by inverse document frequency and has length
one, so words and forms span the space alike, whatever a text is made of. The
terms are reduced to a few latent dimensions by a singular value decomposition
(subspace iterations from a fixed start). Weights and decomposition are fitted to a
bounded sample of labelled rows (``SAMPLE`` documents by a hash of their ids, whole
texts, as many as ``SAMPLE_CHARS`` characters of a class allow); the sample's unit
vectors and labels are broadcast (``SAMPLE`` x ``DIMENSIONS`` floats, 1 MB). Every
document's cosines with all of them are computed exactly, a block of documents at a
time, and the ``NEIGHBOURS`` nearest vote with their similarity as weight. The score
is the positive share of the vote, with the share of positive labels in the whole
training table as a vote of weight one.

Null and empty texts have no direction: they score that share, as do texts similar
to nothing. Without labels every score is 1 and a warning says so. Repeated rows give
one row each; other columns are passed by.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held_out, labels as label_table, map_texts, text_of
from .crf_toxicity import training_sample

#: Labelled rows that the space is fitted to, characters of a class at most, latent dimensions, votes.
SAMPLE, SAMPLE_CHARS, DIMENSIONS, NEIGHBOURS = 4000, 16_000_000, 48, 15
#: Characters that are counted at once in a task.
PART_CHARS = 1 << 21
THRESHOLD = 0.3
_FORMS_WIDTH, _WORDS_WIDTH = 1024, 2048
_WIDTH = _FORMS_WIDTH + _WORDS_WIDTH
_RUNS = re.compile(r"(.)\1+")
_FORMS = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)},
                        **{chr(c): "9" for c in range(48, 58)}})


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, other signs kept, runs shortened to two."""
    form = word.translate(_FORMS)
    if not form.isascii():
        form = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isnumeric() else c for c in form)
    return _RUNS.sub(r"\1\1", form)


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Terms(dict):
    """Word to its shape's hash and its own, emptied at ``limit`` words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = _crc(shape(word)), _crc(word.lower())
        return h


def counts(texts: list[str], terms: Terms) -> np.ndarray:
    """Term counts of whole texts, a row each: forms, then words."""
    out = np.zeros((len(texts), _WIDTH), dtype=np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        n = len(words)
        both = np.array(list(map(terms.__getitem__, words)), np.int64)
        s, w = both[:, 0], both[:, 1]
        same = sum(map(str.__eq__, words, words[1:]))
        row = out[i]
        row[:512] = np.bincount(s % 512, minlength=512) / n
        if n > 1:
            row[512:960] = np.bincount((s[:-1] * 31 + s[1:] * 17) % 448, minlength=448) / n
        row[960] = same / n
        row[961] = len(set(words)) / n
        row[962 + min(15, n.bit_length())] = 0.2
        row[980] = text.count("\n") / n
        row[_FORMS_WIDTH:] = np.bincount(w % _WORDS_WIDTH, minlength=_WORDS_WIDTH) / n
    return out


@dataclass
class Neighbours:
    weights: np.ndarray   # inverse document frequencies
    axes: np.ndarray      # terms x dimensions
    vectors: np.ndarray   # labelled unit vectors
    labels: np.ndarray
    prior: float

    def weighted(self, x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Weighted terms, each block of length one."""
        z = np.sqrt(x, out=out)
        z *= self.weights
        for block in (z[:, :_FORMS_WIDTH], z[:, _FORMS_WIDTH:]):
            block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-12)
        return z

    def embed(self, x: np.ndarray) -> np.ndarray:
        return _directions(self.weighted(x) @ self.axes)

    def scores(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Similarity-weighted votes of the nearest labelled vectors."""
        out = np.full(len(x), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(x), block):
            z = self.embed(x[at:at + block])
            cosine = z @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** 8
            out[at:at + block] = ((w * self.labels[near]).sum(axis=1) + self.prior) / (w.sum(axis=1) + 1.0)
        return out


def _directions(z: np.ndarray) -> np.ndarray:
    return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def latent_axes(a: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``a``, by subspace iterations."""
    q = np.random.default_rng(1).normal(size=(a.shape[1], min(dimensions + 16, *a.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, right = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ right.T)[:, :dimensions]


def fit(texts: list[str], y: list[int], prior: float | None = None) -> Neighbours:
    """``prior`` is the share of positive labels; None takes the sample's."""
    label = np.asarray(y, dtype=float)
    empty = np.zeros((0, DIMENSIONS), np.float32)
    if not len(label):
        return Neighbours(np.ones(_WIDTH, np.float32), np.zeros((_WIDTH, DIMENSIONS), np.float32), empty, label, 1.0)
    terms = Terms()
    x, have = np.empty((len(texts), _WIDTH), np.float32), np.zeros(_WIDTH, np.int64)
    for i in range(0, len(texts), 500):
        x[i:i + 500] = counts(texts[i:i + 500], terms)
        have += np.count_nonzero(x[i:i + 500], axis=0)
    idf = np.log((1 + len(x)) / (1 + have)) + 0.5
    model = Neighbours(idf.astype(np.float32), empty, empty, label, float(label.mean()) if prior is None else prior)
    for i in range(0, len(x), 500):
        model.weighted(x[i:i + 500], out=x[i:i + 500])
    model.axes = latent_axes(x, DIMENSIONS)
    model.vectors = _directions(x @ model.axes)
    return model


def fit_from_tables(docs: DataFrame, labels: DataFrame, train) -> Neighbours:
    share = {0: SAMPLE // 3, 1: SAMPLE - SAMPLE // 3}
    texts, y = training_sample(docs, labels, "quality", train, share, SAMPLE_CHARS)
    prior = labels.where(train).agg(F.avg(F.col("quality").cast("double")).alias("p")).first().p
    return fit(texts, y, prior)


def with_quality(rows: DataFrame, model: Neighbours, text_col: str = "text", keep_text: bool = True, score: str = "score") -> DataFrame:
    """``rows`` with the score of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scorer():
        terms = Terms()
        return lambda texts: [pa.array(np.concatenate([shared.value.scores(counts(texts[i:i + 500], terms)) for i in range(0, len(texts), 500)]), pa.float64())]
    return map_texts(rows, text_col, scorer, f"`{score}` double", PART_CHARS, keep_text)


def score_quality(docs: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return with_quality(rows, model, keep_text=False)


def op9_knn_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out("doc_id", 5, 0)
    model = fit_from_tables(docs, label_table(spark, sf_dir), ~out)
    return (score_quality(docs, model).withColumn("held_out", out)
            .select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
