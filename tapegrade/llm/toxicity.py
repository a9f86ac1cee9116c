"""Toxicity: a word-presence classifier with a counterfactual penalty on identity terms.

A text's features are the distinct lower-cased words (runs of letters) it holds, and their distinct substrings of
``GRAM`` bytes, by 64-bit hash. Training takes a bounded sample of labelled rows (``bound``, 12,000 by default), counts features
by class on the executors, keeps those (``most``, 2,000 by default) that are in enough rows and tell the classes apart best, and minimises logistic loss + ridge + ``penalty`` times the mean
squared change of the margin when an identity term of a labelled sentence is swapped for another
one of its list. A swap changes all features of both terms, words and substrings, or the words alone where the rest of the
sentence holds the substrings; both changes are penalised. A term that is merely frequent in toxic rows thus cannot carry weight of its own:
all terms of a list are drawn to the same weight, and since terms are also swapped for a neutral word, to that word's. Documents are scored whole on the executors, as vectorised sums of weights of
their distinct words.

Defined results: a null or empty text has no words and gets the intercept's score. If the sample lacks a
class, the score is the sample's mean (0.5 without any sample).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, buffers, lean, prepare, slices, span_hashes, word_spans
from .labelled import held_out, training_sample

#: Interchangeable group names, by kind (fixed values; a parameter of ``train``).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "trans"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
NEUTRAL = "people"
#: Bytes of the substrings that are features beside whole words.
GRAM = 4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_keys(words) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _LETTER[data])
    return span_hashes(LOWER[data], starts, ends)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of all words and their substrings, with repeats."""
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offsets, _LETTER[low])
    size = ends - starts
    grams = np.maximum(size - GRAM + 1, 0)
    at = np.repeat(starts, grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    return np.concatenate([doc, np.repeat(doc, grams)]), np.concatenate([span_hashes(low, starts, ends), span_hashes(low, at, at + GRAM, seed=11)])


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct words and substrings of each document, sorted."""
    doc, keys = terms_of(data, offsets)
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])
        doc, keys = doc[new], keys[new]
    return doc, keys


@dataclass
class Model:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        margin = np.full(n, self.intercept)
        doc, found = terms_of(data, offsets)
        if len(found) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            pairs = np.unique(doc[hit] * len(self.keys) + at[hit])
            margin += np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], n)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def identity_groups(terms=IDENTITY_TERMS) -> list[np.ndarray]:
    return [word_keys([*g, NEUTRAL]) for g in terms]


def identity_features(terms=IDENTITY_TERMS) -> list[list[np.ndarray]]:
    """All features, word and substrings, of each term of each list and of the neutral word."""
    raw = [[np.frombuffer(w.encode(), np.uint8) for w in (*g, NEUTRAL)] for g in terms]
    return [[distinct_terms(data, np.array([0, len(data)]))[1] for data in g] for g in raw]


def solved(times, right: np.ndarray, scale: np.ndarray, exact: float = 1e-8, most: int = 2000) -> np.ndarray:
    """The vector that the positive definite map ``times`` takes to ``right``, by conjugate gradients scaled by the map's diagonal."""
    out, rest = np.zeros(len(right)), right.copy()
    way = step = rest / scale
    norm, goal = rest @ step, exact**2 * (right @ (right / scale))
    for _ in range(most):
        if norm <= goal:
            break
        ahead = times(way)
        far = norm / (way @ ahead)
        out = out + far * way
        rest = rest - far * ahead
        step = rest / scale
        norm, before = rest @ step, norm
        way = step + norm / before * way
    return out


def fit(rows: list[tuple[np.ndarray, int]], chosen: np.ndarray, terms=IDENTITY_TERMS, penalty: float = 10.0, ridge: float = 0.1, steps: int = 30) -> Model:
    """Fits on (distinct hashes, label) rows with the chosen hashes and the identity terms as features."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log(mean / (1 - mean))))
    doc = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    every = np.concatenate([k for k, _ in rows]) if len(doc) else np.zeros(0, U64)
    groups = identity_groups(terms)
    keys = np.unique(np.concatenate([chosen.astype(U64), *groups]))
    column = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
    hit = keys[column] == every
    # rows are kept as the places of their features: memory follows what rows hold, not rows times features
    doc, column = doc[hit], column[hit]
    held = np.bincount(column, minlength=len(keys))
    # the change of the features when a term of a labelled row is swapped for each other one of its list
    swaps, place = [], {int(k): j for j, k in enumerate(keys)}
    for g, features in zip(groups, identity_features(terms)):
        words = [place[int(k)] for k in g]
        cols = [[place[int(k)] for k in f if int(k) in place] for f in features]
        for a in range(len(words) - 1):
            n = held[words[a]]
            for b in range(len(words)) if n else ():
                if words[a] != words[b]:
                    d = np.zeros((2, len(keys)))
                    d[0, words[a]], d[0, words[b]] = 1, -1
                    d[1, cols[a]] += 1
                    d[1, cols[b]] -= 1
                    swaps.append(d * np.sqrt(n / len(rows)))
    d = np.concatenate(swaps) if swaps else np.zeros((0, len(keys)))
    # rows of the rarer class weigh more, by the square root of the classes' ratio
    rare = float(y.mean() < 0.5)
    share = np.where(y == rare, np.sqrt(max(np.mean(y != rare), 1e-9) / np.mean(y == rare)), 1.0) / len(y)
    # Newton's method with halved steps, each solved by conjugate gradients; the intercept is the last, unpenalised column
    small, tie = ridge / len(y), 2 * penalty / max(1, len(swaps))
    margins = lambda w: np.bincount(doc, w[column], len(y)) + w[-1]
    turned = lambda v: np.append(np.bincount(column, v[doc], len(keys)), v.sum())
    fixed = lambda w: np.append(small * w[:-1] + tie * (d.T @ (d @ w[:-1])), 1e-9 * w[-1])
    steep = np.append(small + tie * (d**2).sum(0), 1e-9)

    def loss(w):
        m = margins(w)
        return float(share @ (np.logaddexp(0, m) - y * m) + w @ fixed(w) / 2)

    w = np.zeros(len(keys) + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -30, 30)))
        slope = turned(share * (p - y)) + fixed(w)
        curve = share * p * (1 - p)
        move = solved(lambda v: turned(curve * margins(v)) + fixed(v), slope, turned(curve) + steep)
        size = 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        last, now = now, loss(w)
        if last - now < 1e-9:
            break
    w, b = w[:-1], w[-1]
    return Model(keys, w, float(b))


def train(docs: DataFrame, labels: DataFrame, bound: int = 12_000, most: int = 2000, least: int = 4, apart: float = 4.0, terms=IDENTITY_TERMS, **shape) -> Model:
    """Two passes over the sample: counts by class choose at most ``most`` features, then rows of those are fitted on the driver."""
    prepare(docs.sparkSession)
    sample = training_sample(docs, labels, "toxic", bound)

    def count(batches):
        for b in batches:
            for part in slices(b, "text"):
                doc, keys = distinct_terms(*buffers(part.column("text")))
                y = part.column("y").to_numpy()[doc]
                found, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, minlength=len(found)).astype(np.int64)), pa.array(np.bincount(at, y, len(found)).astype(np.int64))], names=["key", "seen", "bad"])

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    n, bad = float(size["n"]), float(size["bad"])
    if not 0 < bad < n:
        return fit([(np.zeros(0, U64), int(bad > 0))] * int(n), np.zeros(0, U64), terms)
    counts = sample.mapInArrow(lean(count), "key long, seen long, bad long").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).filter(F.col("seen") >= least)
    # how far a feature's toxic share lies from the other rows', in standard errors
    inside, outside = F.col("seen") + 1, n - F.col("seen") + 1
    gap = F.abs((F.col("bad") + 0.5) / inside - (bad - F.col("bad") + 0.5) / outside) / F.sqrt(bad / n * (1 - bad / n) * (1 / inside + 1 / outside))
    chosen = np.sort(counts.withColumn("z", gap).filter(F.col("z") > apart).orderBy(F.desc("z"), "key").limit(most).select("key").toArrow().column("key").to_numpy().view(U64))
    wanted = np.unique(np.concatenate([chosen, *identity_groups(terms)]))

    def rows(batches):
        for b in batches:
            for part in slices(b, "text"):
                doc, keys = distinct_terms(*buffers(part.column("text")))
                hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
                doc, keys = doc[hit], keys[hit]
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], names=["doc_id", "y", "keys"])

    found = sample.mapInArrow(lean(rows), "doc_id long, y int, keys array<long>").toArrow().sort_by("doc_id")
    lists = [np.asarray(k.values).view(U64) for k in found.column("keys")]
    return fit(list(zip(lists, found.column("y").to_pylist())), chosen, terms, **shape)


def score_documents(docs: DataFrame, model: Model, cut: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                s = model.score(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, cut: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``cut``."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in slices(b, text):
                yield part.filter(pa.array(model.score(*buffers(part.column(text))) < cut))

    return docs.mapInArrow(lean(run), docs.schema)
