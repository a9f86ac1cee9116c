"""Embedding whitening by a randomised range finder and Rayleigh-Ritz.

Every vector becomes whole numbers x = floor(64 c) + 1,000,000, so counts, sums and deviations are exact. The covariance V (divisor n) is
never built from raw products: rows are centred by the exact mean first, and one pass over all rows multiplies V with a block of columns.

1. A pass gives n and the sums S of each dimension.
2. Range finder: ``components`` + OVERSAMPLING random columns are multiplied by V, and orthonormalised; each further power pass does it again.
3. Rayleigh-Ritz: the block's small matrix gives values and vectors. A component is accepted if its residual is at most TOLERANCE of the gap to its
   neighbours, which bounds the angle to the true eigenvector. If some component fails after POWERS passes (flat spectra do), the block is expanded to
   the full dimension, where Rayleigh-Ritz is the full eigenproblem.
4. A pass over all rows measures the covariance of the whitened values, and the last one returns them.

Partial sums of a partition are one matrix; they meet in Spark by their place, and the driver gets dimension * block numbers, at most
dimension squared, whatever the rows.

Defined results: vectors that are null, empty, or hold null or non-finite entries or entries of 2**56 or more (x would not be a long) take no part, nor do those of
another length than the most frequent one (ties: the longer). A null id is an id; rows that repeat an id are rows of their own. Components whose value is
not above rounding (constant or dependent dimensions) have a null ``whitened`` and are left out of ``identity_error``; with no variance at all
``explained`` is null, and without any such component so is ``identity_error``. A deviation beyond a long is null. Fewer dimensions than ``components`` give
that many. An empty table gives an empty one. Columns other than the id and the vector are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
OVERSAMPLING, POWERS, TOLERANCE = 10, 4, 1e-10
#: Entries from here on have no long.
LARGEST = float(1 << 56)
LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and x of the vectors that take part, but for their length."""
    c = F.col("c")
    found = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("c"))
    # a comparison with NaN is false here, as NaN is the largest value
    found = found.filter(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < LARGEST)))
    return found.select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


class Whitening:
    """The fit of one DataFrame of vectors."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 1):
        self.spark = prepare(vectors.sparkSession)
        x = whole_numbers(vectors, vec_id, embedding)
        lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
        self.d, self.n = (lengths.d, lengths.k) if lengths else (0, 0)
        self.x = x.filter(F.size("x") == self.d)
        self.k = min(components, self.d)
        if not self.n:
            return
        self.sums, self.most = self._sums()
        self.values, self.axes, self.trace = self._fit(np.random.default_rng(seed))
        self.real = self.values > self.d * np.finfo(float).eps * self.trace
        self.identity_error = self._identity()

    def _sums(self) -> tuple[np.ndarray, int]:
        """Sums of each dimension, exactly, as objects; and the largest size of a number."""
        d = self.d

        def run(batches):
            high, low, most = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
            for b in batches:
                x = _matrix(b, d)
                high += (x >> 31).sum(0)
                low += (x & 0x7FFFFFFF).sum(0)
                most = max(most, int(np.abs(x).max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(d, most))], names=["at", "high", "low", "most"])

        whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        rows = self.x.select("x").mapInArrow(lean(run), "at int, high long, low long, most long").groupBy("at").agg(whole("high"), whole("low"), F.max("most").alias("most")).collect()
        by = {r["at"]: (int(r["high"]) << 31) + int(r["low"]) for r in rows}
        return np.array([by[k] for k in range(d)], object), max(r["most"] for r in rows)

    def _exact(self):
        """x -> n * x - S, as longs where they fit, else as Python's whole numbers."""
        n, sums = self.n, self.sums
        fits = n * self.most + max(abs(v) for v in sums.tolist()) <= LONG
        longs = sums.astype(np.int64) if fits else None
        return lambda x: x * n - longs if fits else x.astype(object) * n - sums

    def _centred(self):
        """x -> rows less the mean, each entry rounded once."""
        exact, n = self._exact(), self.n
        return lambda x: exact(x).astype(float) / n

    def _totals(self, of, size: int) -> np.ndarray:
        """Sum over all rows of ``of(centred rows)``, ``size`` numbers."""
        centred, d = self._centred(), self.d

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                total += of(centred(_matrix(b, d)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

        rows = self.x.select("x").mapInArrow(lean(run), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["at"]] = r["v"]
        return out

    def _times(self, block: np.ndarray) -> tuple[np.ndarray, float]:
        """V times ``block``, and the trace of V, in a pass over all rows."""
        out = self._totals(lambda c: np.append((c.T @ (c @ block)).ravel(), (c * c).sum()), block.size + 1) / self.n
        return out[:-1].reshape(block.shape), float(out[-1])

    def _fit(self, rng) -> tuple[np.ndarray, np.ndarray, float]:
        d, width = self.d, self.k + OVERSAMPLING
        if width < d:
            self.passes = 1
            moved, trace = self._times(rng.standard_normal((d, width)))
            for _ in range(POWERS):
                basis = np.linalg.qr(moved)[0]
                moved, trace = self._times(basis)
                self.passes += 1
                values, axes, residual = ritz(basis, moved)
                if (residual[: self.k] <= TOLERANCE * gaps(values)[: self.k]).all():
                    return values[: self.k], signed(axes[:, : self.k]), trace
        else:
            self.passes = 0
        basis = np.eye(d)
        moved, trace = self._times(basis)
        self.passes += 1
        values, axes, _ = ritz(basis, moved)
        return values[: self.k], signed(axes[:, : self.k]), trace

    def _map(self) -> np.ndarray:
        """Centred rows times this are the whitened values of the components that are real."""
        return self.axes[:, self.real] / np.sqrt(self.values[self.real])

    def _identity(self) -> float | None:
        to, k = self._map(), int(self.real.sum())
        if not k:
            return None

        def of(c):
            w = c @ to
            return np.append((w.T @ w).ravel(), w.sum(0))

        out = self._totals(of, k * k + k) / self.n
        mean = out[k * k :]
        return float(np.abs(out[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())

    def transform(self) -> DataFrame:
        """One row a vector and component, from 1 on."""
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not self.n:
            return self.spark.createDataFrame([], kinds)
        d, k, real, to, exact, n = self.d, self.k, self.real, self._map(), self._exact(), self.n
        # the largest sum of squares there can be
        small = d * (2 * n * self.most) ** 2 <= LONG

        def run(batches):
            for b in batches:
                off = exact(_matrix(b, d))
                whole = off if small else off.astype(object)
                deviation = (whole * whole).sum(1)
                w = np.full((b.num_rows, k), np.nan)
                w[:, real] = (off.astype(float) / n) @ to
                flat = pa.array(w.ravel(), mask=np.tile(~real, b.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([v if v <= LONG else None for v in deviation.tolist()], pa.int64()), lists], names=["vec_id", "deviation", "w"])

        found = self.x.mapInArrow(lean(run), "vec_id long, deviation long, w array<double>")
        found = found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
        shares = F.array(*[F.lit(float(v / self.trace) if self.trace > 0 else None).cast("double") for v in self.values])
        error = F.lit(self.identity_error).cast("double")
        return found.select(
            "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), error.alias("identity_error")
        )


def ritz(basis: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by falling size, vectors and residuals of the matrix that takes ``basis`` to ``moved``."""
    small = basis.T @ moved
    values, w = np.linalg.eigh((small + small.T) / 2)
    values, w = np.maximum(values[::-1], 0), w[:, ::-1]
    axes = basis @ w
    return values, axes, np.linalg.norm(moved @ w - axes * values, axis=0)


def gaps(values: np.ndarray) -> np.ndarray:
    """Distance of each value of a falling list to the nearest other."""
    step = np.append(np.abs(np.diff(values)), np.inf)
    return np.minimum(step, np.concatenate([[np.inf], step[:-1]]))


def signed(axes: np.ndarray) -> np.ndarray:
    """Each column with its largest entry above zero."""
    return axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, **names) -> DataFrame:
    return Whitening(vectors, components, **names).transform()
