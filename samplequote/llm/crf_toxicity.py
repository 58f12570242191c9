"""Operator 7: toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not, so training tokens get their labels from
the documents: in a document labelled toxic, the tokens whose word or prefix is
far more frequent in toxic documents are tagged toxic; all other tokens are
clean. A field of two states (clean, toxic) is fitted to these tokens by maximum
likelihood: the emission is the sum of weights of hashed word, prefixes and
suffix, and three weights score the transitions; all are fitted together.
Forward-backward marginals give each token's probability; a document's score is a
logistic function of the expected number of toxic tokens and of the largest
marginal, fitted to the document labels. Tokens with a marginal of at least a half
form the offending spans (code point offsets in the original text).

The model is fitted on the driver from a bounded sample of labelled rows that the
table holds: ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents by a hash of their
ids, whole texts, as many as ``SAMPLE_CHARS`` characters of a class allow. It is
8 MB at most and is broadcast. Scoring is one map-only pass over whole texts, a
part of about ``PART_CHARS`` characters of an Arrow batch at a time (a longer text
alone); the recursion runs over stretches of ``SEGMENT`` tokens side by side.

Null and empty texts and texts without words score as documents without toxic
tokens. Where the table holds no labelled rows of both kinds, every score is near 0
and a warning says so. Repeated rows give one row each; the labels of a repeated id
count as their maximum (of several texts the first in order is fitted); null labels
are left out; other columns are passed by.
"""

from __future__ import annotations

import re
import warnings
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, documents, held_out, labels as label_table, map_texts, text_of

#: Labelled rows that the model is fitted to, and characters of a class at most.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 900, 2700, 16_000_000
#: Tokens of a stretch of the recursion, characters that are split into words at once.
SEGMENT, PART_CHARS = 64, 1 << 20
#: Tokens of the sample that the fit goes through at once.
FIT_TOKENS = 200_000
_BUCKETS = 1 << 21
_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")


def features(word: str) -> list[int]:
    """Hashed features of one token: the word, its prefixes and its suffix."""
    w = word.lower()
    names = [f"w {w}", *(f"{k} {w[:k]}" for k in range(4, 9) if len(w) >= k), f"s {w[-3:]}"]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % _BUCKETS for n in names]


@dataclass
class Field:
    """Weights of a fitted field and of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(_BUCKETS, np.float32))
    bias: float = -20.0
    stay: float = 0.0    # toxic to toxic
    enter: float = 0.0   # clean to toxic
    leave: float = 0.0   # toxic to clean
    score: tuple = (-20.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        return self.bias + float(self.weights[features(word)].sum())


class Emissions(dict):
    """Emissions of the words met by a task, emptied at ``limit`` words."""

    def __init__(self, model: Field, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        e = self[word] = self.model.emission(word)
        return e


def _odds(w: np.ndarray, begin: np.ndarray, doc_of: np.ndarray, n_docs: int, matrix, start: float) -> np.ndarray:
    """Odds after each token of a chain of fractional maps o -> (a o + b) / (c o + d),
    where ``matrix`` gives a, b, c, d of tokens. ``begin`` holds the offsets of the
    stretches, with the end appended, ``doc_of`` their documents in order; each
    document starts from the odds ``start``. The maps of a stretch are multiplied, the
    stretches chained by document, and each then run from the odds it begins with."""
    length = np.diff(begin)
    order = np.argsort(-length, kind="stable")
    first, size = begin[:-1][order], length[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    a, b, c, d = (np.full(len(first), x) for x in (1.0, 0.0, 0.0, 1.0))
    for t, k in enumerate(active):
        p, q, r, u = matrix(first[:k] + t)
        na, nb = p * a[:k] + q * c[:k], p * b[:k] + q * d[:k]
        nc, nd = r * a[:k] + u * c[:k], r * b[:k] + u * d[:k]
        top = np.maximum(np.maximum(na, nb), np.maximum(nc, nd))
        a[:k], b[:k], c[:k], d[:k] = na / top, nb / top, nc / top, nd / top
    whole = np.empty((4, len(first)))
    whole[:, order] = a, b, c, d
    into = np.empty(len(first))
    at = np.concatenate(([0], np.cumsum(np.bincount(doc_of, minlength=n_docs))))
    count = np.diff(at)
    ranked = np.argsort(-count, kind="stable")
    now = np.full(n_docs, start)
    for t, k in enumerate(np.searchsorted(-count[ranked], -np.arange(int(count.max()) if n_docs else 0), side="left")):
        docs = ranked[:k]
        j = at[docs] + t
        into[j] = now[docs]
        m = whole[:, j]
        now[docs] = (m[0] * now[docs] + m[1]) / (m[2] * now[docs] + m[3])
    out, now = np.empty(len(w)), into[order]
    for t, k in enumerate(active):
        p, q, r, u = matrix(first[:k] + t)
        now[:k] = (p * now[:k] + q) / (r * now[:k] + u)
        out[first[:k] + t] = now[:k]
    return out


def chain(e: np.ndarray, starts: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of toxic by the tokens up to each token, odds of what follows it, and
    exp of its emission; ``e`` holds the emissions of all sequences one after the
    other, ``starts`` their offsets with the end appended."""
    w = np.exp(np.clip(e, -60, 60))
    stay, enter, leave = np.exp(model.stay), np.exp(model.enter), np.exp(model.leave)
    n_docs = len(starts) - 1
    lengths = np.diff(starts)
    pieces = -(-lengths // SEGMENT)
    doc_of = np.repeat(np.arange(n_docs), pieces)
    inner = np.arange(len(doc_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.append(starts[doc_of] + inner * SEGMENT, len(w))
    head = np.zeros(len(w), bool)
    head[starts[:-1][lengths > 0]] = True

    def forward(at):
        h = head[at]
        return np.where(h, 0.0, w[at] * stay), np.where(h, w[at], w[at] * enter), np.where(h, 0.0, leave), 1.0

    ahead = _odds(w, begin, doc_of, n_docs, forward, 1.0)
    # what follows a token: the same from the end, each map made by the token before
    back = w[::-1]
    tail = np.zeros(len(w), bool)
    tail[len(w) - starts[1:][lengths > 0]] = True

    def backward(at):
        t, y = tail[at], back[np.maximum(at - 1, 0)]
        return np.where(t, 0.0, stay * y), np.where(t, 1.0, leave), np.where(t, 0.0, enter * y), 1.0

    turned = (len(w) - starts)[::-1]
    lengths, pieces = lengths[::-1], pieces[::-1]
    doc_of = np.repeat(np.arange(n_docs), pieces)
    inner = np.arange(len(doc_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.append(turned[doc_of] + inner * SEGMENT, len(w))
    behind = _odds(back, begin, doc_of, n_docs, backward, 1.0)[::-1]
    return ahead, behind, w


def marginals(e: np.ndarray, starts: np.ndarray, model: Field) -> np.ndarray:
    """P(toxic) of each token."""
    ahead, behind, _ = chain(e, starts, model)
    return 1.0 / (1.0 + 1.0 / np.maximum(ahead * behind, 1e-30))


def transition_counts(ahead, behind, w, joined, model: Field) -> np.ndarray:
    """Expected toxic-to-toxic, clean-to-toxic and toxic-to-clean steps into the
    tokens at ``joined``, which follow another of their sequence."""
    a, y = ahead[joined - 1], w[joined] * behind[joined]
    stay, enter, leave = a * y * np.exp(model.stay), y * np.exp(model.enter), a * np.exp(model.leave)
    return np.array([(x / (1.0 + stay + enter + leave)).sum() for x in (stay, enter, leave)])


def document_inputs(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document log(1 + expected toxic tokens) and the largest marginal."""
    out = np.zeros((len(starts) - 1, 2))
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        out[some, 0] = np.log1p(np.add.reduceat(p, starts[some]))
        out[some, 1] = np.maximum.reduceat(p, starts[some])
    return out


def document_scores(x: np.ndarray, model: Field) -> np.ndarray:
    b, w1, w2 = model.score
    return 1.0 / (1.0 + np.exp(-np.clip(b + w1 * x[:, 0] + w2 * x[:, 1], -30, 30)))


# --- fitting --------------------------------------------------------------------

def independent(texts: list[str]) -> list[int]:
    """Positions of texts that share none of four minwise three-word shingles
    with an earlier one: copies of a document are one observation, else any word
    of a much copied toxic document would look toxic."""
    seen, chosen = set(), []
    for i, text in enumerate(texts):
        w = text.lower().split()
        hashes = np.array([zlib.crc32(" ".join(w[k:k + 3]).encode("utf-8", "surrogatepass"))
                           for k in range(max(1, len(w) - 2))], dtype=np.uint64)
        mins = {(k, int(((hashes * np.uint64(2 * k + 0x9E3779B1)) % np.uint64(0xFFFFFFFB)).min())) for k in range(4)}
        if not mins & seen:
            chosen.append(i)
        seen |= mins
    return chosen


def _indexed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each text as numbers, and the features of each numbered word (a row,
    filled up with ``_BUCKETS``). Words are told apart in lower case."""
    vocabulary: dict[str, int] = {}
    docs = []
    for text in texts:
        found = _WORD.findall(text)
        docs.append(np.fromiter((vocabulary.setdefault(w.lower(), len(vocabulary)) for w in found), np.int32, len(found)))
    table = np.full((len(vocabulary), 7), _BUCKETS, dtype=np.int32)
    for w, i in vocabulary.items():
        f = features(w)
        table[i, :len(f)] = f
    return docs, table


def _marking(docs: list[np.ndarray], table: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic documents: ten times as frequent there as in
    clean ones, beyond chance by a likelihood ratio test (G over 27, a chance of
    one in millions, as many features are tested), and not rare in documents that
    much commoner ones mark already (those are words that toxic documents share
    by a common passage). A feature is tested by the documents that have it at
    all and by those that have it on two distinct words or more, as a prefix of
    toxic words can begin a clean word by chance, but seldom two of a document."""
    seen = np.zeros((2, 2, _BUCKETS + 1), dtype=np.int32)
    for ids, y in zip(docs, toxic):
        f, n = np.unique(table[np.unique(ids)].ravel(), return_counts=True)
        seen[0, int(y), f] += 1
        seen[1, int(y), f[n > 1]] += 1
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    share = n1 / (n1 + n0)
    found = np.zeros(_BUCKETS + 1, dtype=np.int32)
    for clean, marked_by in seen:
        f = np.flatnonzero(marked_by[:_BUCKETS])
        a, b = marked_by[f].astype(float), clean[f].astype(float)
        g = 2 * (a * np.log(a / ((a + b) * share)) + b * np.log(np.maximum(b, 1) / ((a + b) * (1 - share))) * (b > 0))
        f = f[(g > 27) & (a / n1 >= 10 * (b + 0.5) / n0)]
        found[f] = np.where(found[f] > 0, found[f], marked_by[f])
    names = np.flatnonzero(found)
    marked: dict[int, list[int]] = {int(f): [] for f in names}
    for d in np.flatnonzero(toxic).tolist():
        mine = np.unique(table[np.unique(docs[d])].ravel())
        for f in mine[found[mine] > 0].tolist():
            marked[f].append(d)
    strength, chosen = np.zeros(len(docs)), []
    for f in sorted(marked, key=lambda f: (-found[f], f)):
        if found[f] >= 0.3 * np.median(strength[marked[f]]):
            chosen.append(f)
            strength[marked[f]] = np.maximum(strength[marked[f]], found[f])
    return np.array(chosen, dtype=np.int64)


def fit(texts: list[str], toxic: list[int], rounds: int = 30, rate: float = 0.4) -> Field:
    """Maximum likelihood of the tags, emissions and transitions together, by Adam over
    all tokens of the sample, ``FIT_TOKENS`` or a document at a time; then the score's
    logistic regression. Deterministic."""
    first = independent(texts)
    texts, y = [texts[i] for i in first], np.asarray([toxic[i] for i in first])
    model = Field()
    if not len(y) or y.min() == y.max():
        return model
    docs, table = _indexed(texts)
    del texts
    tagging = _marking(docs, table, y)
    if not len(tagging):
        return model
    tagged = np.isin(table, tagging).any(axis=1)
    # weights of the features that occur, the last for the filling
    used, slot = np.unique(np.append(table.ravel(), _BUCKETS), return_inverse=True)
    table = slot[:-1].reshape(table.shape)
    n_words, n_used = len(table), len(used)
    parts = []
    for i, j in by_size([len(d) for d in docs], FIT_TOKENS):
        ids = np.concatenate(docs[i:j])
        starts = np.concatenate(([0], np.cumsum([len(d) for d in docs[i:j]]))).astype(np.int64)
        tags = tagged[ids] & np.repeat(y[i:j] == 1, np.diff(starts))
        follows = np.ones(len(ids), bool)
        follows[starts[:-1][np.diff(starts) > 0]] = False
        parts.append((ids, starts, tags, np.flatnonzero(follows)))
    del docs
    n_tags, n_tokens = sum(int(p[2].sum()) for p in parts), sum(len(p[0]) for p in parts)
    # relative to clean after clean, which scores 0
    w = np.zeros(n_used)
    free = np.array([float(np.log((n_tags + 1) / (n_tokens + 1))), 0.0, 0.0, 0.0])  # bias, stay, enter, leave
    m, v, mf, vf = np.zeros_like(w), np.zeros_like(w), np.zeros(4), np.zeros(4)
    for step in range(1, rounds + 1):
        model.stay, model.enter, model.leave = free[1:]
        emission = free[0] + w[table].sum(axis=1)
        miss, gf = np.zeros(n_words), np.concatenate(([0.0], -0.02 * free[1:]))
        for ids, starts, tags, joined in parts:
            ahead, behind, odds = chain(emission[ids], starts, model)
            left = tags - 1.0 / (1.0 + 1.0 / np.maximum(ahead * behind, 1e-30))
            miss += np.bincount(ids, weights=left, minlength=n_words)
            now, prev = tags[joined], tags[joined - 1]
            seen = np.array([(now & prev).sum(), (now & ~prev).sum(), (~now & prev).sum()])
            gf += np.concatenate(([left.sum()], seen - transition_counts(ahead, behind, odds, joined, model)))
        g = np.bincount(table.ravel(), weights=np.repeat(miss, table.shape[1]), minlength=n_used) - 0.02 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mf, vf = 0.9 * mf + 0.1 * gf, 0.99 * vf + 0.01 * gf * gf
        a, b = 1 - 0.9 ** step, 1 - 0.99 ** step
        w += rate * (m / a) / (np.sqrt(v / b) + 1e-6)
        free += rate * (mf / a) / (np.sqrt(vf / b) + 1e-6) * np.array([1.0, 0.25, 0.25, 0.25])
        w[-1] = 0.0
    model.weights[used[:-1]] = w[:-1]
    model.bias, model.stay, model.enter, model.leave = map(float, free)
    emission = model.bias + w[table].sum(axis=1)
    x = np.concatenate([document_inputs(marginals(emission[ids], starts, model), starts) for ids, starts, _, _ in parts])
    design = np.column_stack([np.ones(len(y)), x])
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (q * (1 - q))[:, None]).T @ design + np.diag([1e-3, 0.05, 0.05])
        beta += np.linalg.solve(hess, design.T @ (y - q) - np.array([0, 0.05, 0.05]) * beta)
    model.score = tuple(float(b) for b in beta)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: dict[int, int],
                    chars: int, id_col: str = "doc_id", text_col: str = "text"):
    """(texts, labels) of a bounded sample of the labelled rows that ``docs`` holds:
    ``per_class`` rows of each label by a hash of the id, ``train`` a condition on
    doc_id, as many of them as ``chars`` characters of a class allow (one at least)."""
    one = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
           .where(F.col("y").isNotNull() & train).groupBy("doc_id").agg(F.max("y").alias("y")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sizes = texts.groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("size"))
    held = one.join(sizes, "doc_id").withColumn("place", F.xxhash64("doc_id"))
    chosen = None
    for y, n in per_class.items():
        part = held.where(F.col("y") == y).orderBy("place", "doc_id").limit(n)
        earlier = F.sum("size").over(Window.orderBy("place", "doc_id")) - F.col("size")  # over n rows
        part = part.withColumn("earlier", earlier).where((F.col("earlier") + F.col("size") <= chars) | (F.col("earlier") == 0))
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (texts.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: r.doc_id)
    missing = [y for y in per_class if not any(r.y == y for r in rows)]
    if missing:
        warnings.warn(f"no labelled rows with {label} {missing}: the model tells nothing apart", stacklevel=2)
    return [r.text for r in rows], [r.y for r in rows]


def fit_from_tables(docs: DataFrame, labels: DataFrame, train) -> Field:
    return fit(*training_sample(docs, labels, "toxic", train, {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}, SAMPLE_CHARS))


# --- scoring --------------------------------------------------------------------

SPANS = "array<struct<start:int,end:int,p:double>>"


def emissions(text: str, memo: Emissions) -> np.ndarray:
    """Emissions of the words of a text, split into words a stretch at a time."""
    parts, at = [], 0
    while at < len(text) or not parts:
        gap = _GAP.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
        end = gap.start() if gap else len(text)
        words = _WORD.findall(text, at, end)
        parts.append(np.fromiter(map(memo.__getitem__, words), float, len(words)))
        at = max(end, at + 1)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def tag_batch(texts: list[str], memo: Emissions, spans: bool = True):
    """Scores of a batch of texts and, if asked for, their toxic spans."""
    es = [emissions(t, memo) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(e) for e in es]))).astype(np.int64)
    p = marginals(np.concatenate(es) if es else np.zeros(0), starts, memo.model)
    del es
    scores = document_scores(document_inputs(p, starts), memo.model)
    if not spans:
        return scores, None
    hits: list[list] = [[] for _ in texts]
    hot = np.flatnonzero(p >= 0.5)
    for d in np.unique(np.searchsorted(starts, hot, side="right") - 1).tolist():
        mine = p[starts[d]:starts[d + 1]]
        for i, m in enumerate(_WORD.finditer(texts[d])):
            if mine[i] >= 0.5:
                hits[d].append({"start": m.start(), "end": m.end(), "p": float(mine[i])})
    return scores, hits


def with_toxicity(rows: DataFrame, model: Field, text_col: str = "text", spans: bool = True, keep_text: bool = True,
                  score: str = "score") -> DataFrame:
    """``rows`` with the score of each text and, if asked for, its spans."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def scorer():
        memo = Emissions(shared.value)

        def run(texts):
            scores, hits = tag_batch(texts, memo, spans)
            return [pa.array(scores, pa.float64())] + ([pa.array(hits, kind)] if spans else [])
        return run
    return map_texts(rows, text_col, scorer, f"`{score}` double" + (f", spans {SPANS}" if spans else ""), PART_CHARS, keep_text)


def score_toxicity(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return with_toxicity(rows, model, keep_text=False)


THRESHOLD = 0.7


def op7_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out("doc_id", 3, 1)
    model = fit_from_tables(docs, label_table(spark, sf_dir), ~out)
    return (score_toxicity(docs, model).withColumn("held_out", out)
            .select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans"))
