"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook of K centroids, which makes K*K
cells for the price of 2K centroids. The codebooks are fitted on a bounded sample (``sample`` rows, 20,000 by default, smallest
hashes of the id); every vector is indexed. A query takes centroid pairs in ascending order of the sum of its two
halves' distances, found with a heap over the two sorted distance lists, until the cells visited hold
``candidates`` vectors, and what they hold is reranked by the exact cosine of the original
vectors in double precision.

Equal vectors are one entry with their ``k + 1`` smallest ids (more cannot be among any query's k nearest, its
own row left out), and equal queries are one search, so a vector that a third of all rows share costs
no more than another one. A cell's entries and its probes are cut into pieces of bounded size, and each pair of
pieces is scored on its own.

``candidates`` is calibrated unless given: on the sample, the share of all vectors that a query must visit to
find ``recall`` of its true neighbours is measured against brute force, and that share of the table is visited
at every size (``MultiIndex.visited``; k + 1 vectors at least, as k could not be found else). Vectors without structure
need a large share, clustered ones a small one. Measured recall is in the README.

Defined results: rows with a null id, a null or empty vector, null or non-finite components, or only zeros take no part, nor do
vectors whose length is not the table's most frequent one (the longer one, of two as frequent). Rows that repeat
an id count as one row a vector. Ties in the score go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, prepare, saved


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centre)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centre


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)[None, :]


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return distances(x, centre).argmin(1)


def traverse(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Cells in ascending order of first[i] + second[j], until they hold ``wanted`` vectors."""
    k = len(first)
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    f, s = first[a].tolist(), second[b].tolist()
    heap, done, out, got = [(f[0] + s[0], 0, 0)], [0] * k, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if held[cell]:
            out.append(cell)
            got += int(held[cell])
        done[i] = j + 1
        # a pair is reachable once the one above it and the one before it are done
        if i + 1 < k and done[i + 1] == j:
            heapq.heappush(heap, (f[i + 1] + s[j], i + 1, j))
        if j + 1 < k and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (f[i] + s[j + 1], i, j + 1))
    return out


class MultiIndex:
    """Codebooks and the indexed entries of one table of vectors."""

    def __init__(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, sample: int = 20_000, cell_rows: int = 64, candidates: int | None = None, recall: float = 0.95, bucket_bytes: int = 16 << 20):
        self.spark, self.k = prepare(vectors.sparkSession), k
        self.source = vectors
        kind = vectors.schema[embedding].dataType.elementType.simpleString()
        self.kind = kind if kind in ("float", "double") else "double"
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{self.kind}>").alias("v"))
        usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
        rows = rows.filter(usable)
        lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        self.dims = lengths["d"] if lengths else 0
        self.rows = rows.filter(F.size("v") == self.dims)
        rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
        # ranked before the shuffle too, so at most k + 1 rows a vector and task move
        few = self.rows.select("vec_id", "v").withColumn("r", rank).filter(F.col("r") <= k + 1)
        distinct = few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0])
        self.distinct = saved(distinct)
        n = self.distinct.count()
        picked = self.distinct.select("entry", "v").orderBy(F.xxhash64("entry"), "entry").limit(sample).toArrow()
        x = np.array(picked.column("v").to_pylist(), float).reshape(-1, self.dims) if n else np.zeros((0, 0))
        self.size = int(np.clip(round((n / cell_rows) ** 0.5), 1, min(1024, max(1, len(x)))))
        self.half = self.dims // 2
        self.books = None
        if n:
            x = unit(x)
            self.books = tuple(kmeans(h, self.size, seed=s) if h.shape[1] else np.zeros((self.size, 0)) for s, h in enumerate((x[:, : self.half], x[:, self.half :])))
            self.candidates = candidates or int(np.ceil(n * self._share(x, recall)))
            self.candidates = max(self.candidates, k + 1)
            #: The share of the distinct vectors that a search scores.
            self.visited = min(1.0, self.candidates / n)
            # entries of 8 bytes a component, in buckets of about ``bucket_bytes``
            self.buckets = max(partitions(self.spark), -(-n * (8 * self.dims + 64) // bucket_bytes))
            self.entries = saved(self._cells(self.distinct.select("entry", "ids", "v")))

    def _share(self, x: np.ndarray, recall: float, asked: int = 200) -> float:
        """The share of the sample that queries must visit to find ``recall`` of their true neighbours."""
        x = x[np.any(x != 0, axis=1)]
        q = x[:: max(1, len(x) // asked)][:asked]
        near = q @ x.T
        near[near > 1 - 1e-12] = -2  # the query itself and its equals
        true = np.argsort(-near, axis=1)[:, : min(self.k, len(x))]
        parts = [(h, b) for h, b in zip((x[:, : self.half], x[:, self.half :]), self.books)]
        own = [nearest(h, b) for h, b in parts]
        held = np.bincount(own[0] * self.size + own[1], minlength=self.size**2).reshape(self.size, self.size)
        first, second = distances(q[:, : self.half], self.books[0]), distances(q[:, self.half :], self.books[1])
        shares = []
        for i in range(len(q)):
            total = first[i][:, None] + second[i][None, :]
            shares += [held[total <= total[own[0][t], own[1][t]]].sum() / len(x) for t in true[i]]
        return float(np.quantile(shares, recall)) if shares else 1.0

    def _cells(self, rows: DataFrame) -> DataFrame:
        books, half, size, dims, kind = self.books, self.half, self.size, self.dims, self.kind

        def run(batches):
            for b in batches:
                x = unit(matrix(b.column("v"), dims)) if b.num_rows else np.zeros((0, dims))
                cell = nearest(x[:, :half], books[0]) * size + nearest(x[:, half:], books[1]) if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int64))], names=[*b.schema.names, "cell"])

        return rows.mapInArrow(run, f"entry long, ids array<long>, v array<{kind}>, cell long")

    def search(self, queries: DataFrame, piece: int = 2048) -> DataFrame:
        """query_id, rank, vec_id, score for queries given as rows (query_id, v) of the index' own rows."""
        if self.books is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        books, half, dims, size, wanted, k = self.books, self.half, self.dims, self.size, self.candidates, self.k
        # a histogram over size * size cells, at most 2**20 numbers
        held = np.zeros(size * size, np.int64)
        counts = self.entries.groupBy("cell").count().toArrow()
        held[counts.column("cell").to_numpy()] = counts.column("count").to_numpy()
        asked = saved(queries.select("query_id", "v").distinct())
        searches = saved(asked.groupBy("v").agg(F.min("query_id").alias("search")))

        def probe(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(matrix(b.column("v"), dims))
                first, second = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
                cells = [traverse(f, s, held, wanted) for f, s in zip(first, second)]
                n = [len(c) for c in cells]
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([b.column("search").take(at), pa.array(np.concatenate(cells).astype(np.int64))], names=["search", "cell"])

        probes = saved(searches.select("search", "v").mapInArrow(probe, "search long, cell long"))
        many = lambda t, name: t.groupBy("cell").agg(F.ceil(F.count("*") / piece).cast("int").alias(name))
        # one row a cell, at most 2**20
        plan = F.broadcast(many(self.entries, "es").join(many(probes, "ps"), "cell"))
        part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.entries.join(plan, "cell").withColumn("e", part("entry", "es")).withColumn("p", each("ps")).select("cell", "e", "p", F.col("entry").alias("key"), "ids", "v")
        buckets = self.buckets
        bucket = F.pmod(F.xxhash64("cell", "e", "p"), F.lit(buckets)).cast("int")
        places = probes.join(plan, "cell").withColumn("p", part("search", "ps")).withColumn("e", each("es")).withColumn("bucket", bucket)
        # probes are numbers alone; a search's vector joins them once a bucket
        places = places.groupBy("bucket", "search").agg(F.collect_list("cell").alias("cell"), F.collect_list("e").alias("e"), F.collect_list("p").alias("p"))
        right = places.join(searches, "search").select("bucket", F.col("search").alias("key"), "v", "cell", "e", "p")

        def rerank(_, found, wants):
            entry, asked_by, close = [], [], []
            if found.num_rows and wants.num_rows:
                lists = wants.column("cell").combine_chunks()
                asking = np.repeat(np.arange(wants.num_rows), lists.value_lengths().to_numpy())
                place = [np.column_stack([found.column(c).to_numpy() for c in ("cell", "e", "p")]), np.column_stack([wants.column(c).combine_chunks().flatten().to_numpy() for c in ("cell", "e", "p")])]
                xs = [matrix(t.column("v").combine_chunks(), dims) for t in (found, wants)]
                groups, at = np.unique(np.concatenate(place), axis=0, return_inverse=True)
                a, b = at.ravel()[: len(xs[0])], at.ravel()[len(xs[0]) :]  # of entries, and of probes in the order of ``asking``
                oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
                ea, eb = np.searchsorted(a[oa], np.arange(len(groups) + 1)), np.searchsorted(b[ob], np.arange(len(groups) + 1))
                for g in range(len(groups)):
                    mine, asks = oa[ea[g] : ea[g + 1]], asking[ob[eb[g] : eb[g + 1]]]
                    if not len(mine) or not len(asks):
                        continue
                    near = unit(xs[1][asks]) @ unit(xs[0][mine]).T
                    top = min(k + 1, len(mine))
                    # everything that may tie with the last one stays
                    bar = -np.partition(-near, top - 1, axis=1)[:, top - 1 : top] - 1e-12
                    i, j = np.nonzero(near >= bar)
                    entry.append(mine[j])
                    asked_by.append(asks[i])
                    close.append(near[i, j])
            if not entry:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.float64())], names=["search", "entry", "ids", "score"])
            entry, asked_by, close = (np.concatenate(x) for x in (entry, asked_by, close))
            search = wants.column("key").to_numpy()[asked_by]
            # of all cells here, only what may be among a search's nearest goes on
            order = np.lexsort((-close, search))
            entry, asked_by, close, search = (x[order] for x in (entry, asked_by, close, search))
            first = np.flatnonzero(np.concatenate([[True], search[1:] != search[:-1]]))
            last = np.minimum(first + k, np.append(first[1:], len(search)) - 1)
            keep = close >= np.repeat(close[last] - 1e-12, np.diff(np.append(first, len(search))))
            entry, asked_by, search = entry[keep], asked_by[keep], search[keep]
            e, q = xs[0][entry], xs[1][asked_by]
            score = (q * e).sum(1) / (np.sqrt((q**2).sum(1)) * np.sqrt((e**2).sum(1)))
            rows = pa.array(entry)
            return pa.table([pa.array(search), found.column("key").take(rows), found.column("ids").take(rows), pa.array(score)], names=["search", "entry", "ids", "score"])

        scored = left.withColumn("bucket", bucket).groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(rerank, "search long, entry long, ids array<long>, score double")
        best = scored.withColumn("r", F.row_number().over(W.partitionBy("search").orderBy(F.desc("score"), "entry"))).filter(F.col("r") <= k + 1)
        # per search at most (k + 1) entries of k + 1 ids
        lists = best.groupBy("search").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
        hits = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct((-x["score"]).alias("s"), i.alias("vec_id")))))
        answered = asked.join(searches.join(lists, "search").select(F.col("v"), hits.alias("hits")), "v")
        own = answered.select("query_id", F.slice(F.sort_array(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))), 1, k).alias("hits"))
        return own.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def nearest_rows(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", **shape) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    index = MultiIndex(vectors, vec_id, embedding, k, **shape)
    return index.search(index.rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"))
