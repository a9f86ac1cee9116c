"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics (``text_stats``) are binned into at most 64 quantile bins; trees of fixed depth are grown
level by level on gradient histograms of the logistic loss with Newton leaf values. The fitted ensemble
is flattened into arrays (feature, threshold and value by tree and node), so that scoring a batch is
``depth`` vectorised gathers over all documents and trees at once. The model is fitted on the driver from a
bounded sample of labelled rows (``bound``, 12,000 by default); the statistics of all
documents, sample included, are computed on the executors from whole texts.

Defined results: a null or empty text has statistics of zero and gets the score that they get. If the
sample lacks one of the classes, every score is the sample's mean (0.5 for no sample at all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, prepare, slices
from .labelled import held_out, training_sample
from .text_stats import NAMES, features


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; leaves are the last level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        trees, inner = self.feature.shape
        rows, all_trees = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            right = x[rows, self.feature[all_trees, node]] > self.threshold[all_trees, node]
            node = 2 * node + 1 + right
        return self.base + self.value[all_trees, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate([self.margin(x[k : k + 4096]) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, smoothing: float = 1.0, least: int = 10) -> Trees:
    inner = 2**depth - 1
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return empty
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    empty.base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return empty
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])
    flat = binned + np.arange(k) * bins
    margin = np.full(n, empty.base)
    fs, ts, vs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        f_out, t_out = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            at = (local[:, None] * (k * bins) + flat).ravel()
            shape = (width, k, bins)
            hist = [np.bincount(at, np.repeat(w, k), width * k * bins).reshape(shape).cumsum(2) for w in (g, h, np.ones(n))]
            (gl, hl, cl), (gt, ht, ct) = hist, [a[:, :, -1:] for a in hist]
            gain = gl**2 / (hl + smoothing) + (gt - gl) ** 2 / (ht - hl + smoothing) - gt**2 / (ht + smoothing)
            gain[(cl < least) | (ct - cl < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    f_out[first + i], t_out[first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f_out[node]] > t_out[node])
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smoothing)
        margin += values[leaf]
        fs.append(f_out)
        ts.append(t_out)
        vs.append(values)
    return Trees(empty.base, np.array(fs), np.array(ts), np.array(vs))


def document_features(docs: DataFrame, keep: str = "doc_id long") -> DataFrame:
    """The first column of ``docs`` and its statistics; ``text`` is the second."""
    name = docs.columns[0]

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                x = features(*buffers(part.column("text")))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=[name, "x"])

    return docs.mapInArrow(run, f"{keep}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, bound: int = 12_000, **shape) -> Trees:
    prepare(docs.sparkSession)
    sample = training_sample(docs, labels, "quality", bound)
    rows = document_features(sample.select(F.struct("doc_id", "y").alias("k"), "text"), "k struct<doc_id: long, y: int>").select("k.doc_id", "k.y", "x").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))[order]
    return fit_trees(x, rows.column("y").to_numpy()[order].astype(float), **shape)


def score_documents(docs: DataFrame, trees: Trees, cut: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                s = trees.score(features(*buffers(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
