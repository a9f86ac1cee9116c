"""MinHash near-duplicates: one-permutation sketches with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds the 64-bit hashes of its distinct ``width``-word shingles (of the whole sequence, if it is shorter). Two sets
link when 100 * intersection >= ``percent`` * union.

* Sketches: one hash deals a set's shingles into BINS bins, and each bin keeps its smallest value. An empty bin takes the value of another
  bin that has one, probed in an order that depends on the bin and the attempt alone (optimal densification), so that bins of two sets
  agree with the probability of their similarity. There are SKETCHES independent ones, so that small sets, which fill few bins, do
  not stand or fall by a single deal.
* Bands: each ROWS bins of a sketch make a bucket key. Sets of similarity s share one of the SKETCHES * BINS / ROWS = 64 keys but for
  a probability of (1 - s**6)**64: 4e-9 at 0.8.
* Stars: copies (equal sets) are one class before keys are shuffled. The smallest class of a bucket is its hub, and only the edges (hub, class)
  are emitted, so a bucket of n classes has n candidate edges, not n squared.
* Verification: classes of one hub are compared by parity bits of their sets in blocks of measured bytes, which bounds the intersection
  from above and so loses no link between two classes of a bucket; spanning forests of what may link are verified on the full sets of
  their texts, and hubs with refused edges are searched again until nothing is left (``ngram_jaccard.Join`` has both). A link between two
  members of a bucket is therefore found even if neither links with the hub.
* Components come from alternating stars over checkpointed tables.

Defined results: a null or empty text has an empty set, size 0, and a component of its own. A null id never names a component: such a row
takes the smallest id linked with it, or null, and links that run through it count. Rows that repeat an id are judged by their texts. Rows with equal texts share a
component. ``kept`` is true for rows whose id names their component, and for rows without an id whose component is null. An empty
table gives an empty one. Texts of any length are whole sets; one text must fit a worker's memory. Columns other than the id and the text are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, kept, lean, mix, prepare, saved, sized, slices
from .ngram_jaccard import BLOCK, PART, Join, parity_bits, shingles

SKETCHES, BINS, ROWS = 8, 48, 6
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def one_permutation(doc: np.ndarray, s: np.ndarray, n_docs: int, seed: int, bins: int = BINS) -> np.ndarray:
    """Smallest hash of each of ``bins`` bins of every set, empty bins filled from others; a set without shingles keeps EMPTY."""
    with np.errstate(over="ignore"):
        h = mix(s ^ mix(np.full(1, seed + 1, U64) * U64(0x9E3779B97F4A7C15)))
        at = ((h >> U64(32)) * U64(bins)) >> U64(32)
        table = np.full(n_docs * bins, EMPTY)
        np.minimum.at(table, doc * bins + at.astype(np.int64), h)
        table = table.reshape(n_docs, bins)
        filled = table != EMPTY
        d, j = np.nonzero(~filled & filled.any(1)[:, None])
        out, attempt = table.copy(), 0
        while len(d):
            probe = (mix(j.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64((attempt * 0x165667B19E3779F9 + seed) % 2**64)) % U64(bins)).astype(np.int64)
            hit = filled[d, probe]
            out[d[hit], j[hit]] = table[d[hit], probe[hit]]
            d, j, attempt = d[~hit], j[~hit], attempt + 1
    return out


def band_keys(doc: np.ndarray, s: np.ndarray, n_docs: int) -> np.ndarray:
    """Bucket keys of every set, one a band; bands of different numbers never share a key but by chance."""
    keys = []
    with np.errstate(over="ignore"):
        for k in range(SKETCHES):
            bins = one_permutation(doc, s, n_docs, k)
            for b in range(BINS // ROWS):
                key = np.full(n_docs, k * BINS + b, U64)
                for r in range(ROWS):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + bins[:, b * ROWS + r])
                keys.append(key)
    return np.column_stack(keys)


class MinHash(Join):
    """The join's tables for one DataFrame of documents, with buckets of sketches as candidate search."""

    #: Members of a bucket are near copies of each other, so few spanning forests are refused; hubs with refused edges are searched again.
    forests = 4

    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK):
        self.spark = prepare(docs.sparkSession)
        self.percent, self.width, self.block, self.part = percent, width, block, PART
        self.base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
        self.sets = saved(self._sets())
        # copies meet in partial results first; a row stands for its class by (id, hash of the text)
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "size")).alias("rep")
        found = self.sets.filter("n > 0").groupBy("sig").agg(rep, F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
        self.classes = saved(found.select(F.monotonically_increasing_id().alias("node"), "sig", "n", "bits", "bands", "rep.doc_id", "rep.th", "rep.size"))

    def _sets(self) -> DataFrame:
        width = self.width

        def run(batches):
            for b in batches:
                for part in slices(b, "text"):
                    doc, s = shingles(*buffers(part.column("text")), width)
                    edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    n = np.diff(edge)
                    with np.errstate(over="ignore"):
                        sums = [np.concatenate([[U64(0)], np.cumsum(mix(s ^ U64(seed)), dtype=U64)]) for seed in (0x1234567, 0x89ABCDEF01)]
                        sig = np.column_stack([x[edge[1:]] - x[edge[:-1]] for x in sums])
                    keys = band_keys(doc, s, part.num_rows)
                    ends = np.arange(part.num_rows + 1, dtype=np.int32) * keys.shape[1]
                    columns = {
                        "doc_id": part.column("doc_id"), "th": part.column("th"), "size": pa.array(np.diff(buffers(part.column("text"))[1])), "n": pa.array(n), "sig": pa.array([r.tobytes() for r in sig], pa.binary()),
                        "bits": parity_bits(doc, s, n), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel())),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return self.base.mapInArrow(lean(run), "doc_id long, th long, size long, n long, sig binary, bits binary, bands array<long>")

    def stars(self) -> DataFrame:
        """(hub, node): distinct candidate edges, a hub's own row included."""
        entries = self.classes.select(F.explode("bands").alias("key"), "node")
        # partial results keep one row a key and task, however many classes share the key
        buckets, count = kept(entries.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("key", "hub"))
        return entries.join(sized(buckets, count, 16), "key").select("hub", "node").distinct()

    def members(self) -> DataFrame:
        """(hub, node, n, bits): classes to be compared with each other, under each hub."""
        return self.stars().join(self.classes.select("node", "n", "bits"), "node").select("hub", "node", "n", "bits")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, **names) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    found = MinHash(docs, percent, width, **names).components()
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
