"""Removal of byte strings that an earlier document already has, by suffix arrays.

Each byte that is covered by a ``width``-byte string which also starts in a document with a smaller id is
removed; strings are judged on the input, overlaps count, matches never cross documents. Nothing is sampled
or capped. Runs of strings whose 64-bit digest, 64-bit key and length are all equal count as the same bytes without being compared.

One suffix array of the whole corpus cannot be built in one place, so equal strings are brought together
first. A string's *key* is the smallest hash of its ``gram``-byte substrings; equal strings have equal
keys, and neighbouring strings mostly share one, so a text is a sequence of runs of strings with one
key. Documents are dealt into chunks, keys into buckets, and three passes go back and forth:

1. chunk to bucket: the chunk's distinct keys, five bytes each. Bucket to chunk: one bit a key, whether more than
   one document has it.
2. chunk to bucket: the bytes of the runs with such keys, each distinct one once a chunk, with the smallest id
   that has it. The bucket sorts the suffixes that start strings (``suffix_array``: two-stage sorting, then
   adjacent common prefixes) and takes the smallest id of each class of equal strings. Bucket to chunk: one
   bit a string, whether a smaller id than the run's own has it.
3. in the chunk: a string goes if its bit is set or an earlier document of the chunk has the same run.

What is shuffled for a key or a run is at most one entry a chunk, so a passage in a third of all documents makes
no larger group than the number of chunks. No list of documents, keys or runs reaches the driver.

Defined results: a null text is empty (0 bytes, nothing removed). A null id ranks after every id, so its
rows lose what any numbered document has and cost no other row anything; rows with equal ids are not earlier
than each other. Texts shorter than ``width`` bytes stay whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, U64, buffers, byte_codes, partitions, prepare, span_hashes, tidy, tidy_pair
from .suffix_array import prefix_classes

WIDTH, GRAM = 50, 24
LAST = np.iinfo(np.int64).max
#: Bytes that one suffix array covers, unless a single key has more.
BLOCK = 4 << 20


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on: a polynomial by doubling, then one mixing step."""
    with np.errstate(over="ignore"):
        base = 0x9E3779B97F4A7C15
        power, size = {1: byte_codes()[data]}, 1
        while size * 2 <= gram:
            h = power[size]
            twice = h[:-size] * U64(pow(base, size, 1 << 64))
            twice += h[size:]
            power[size * 2] = twice
            size *= 2
        out, have = power[size], size
        while have < gram:
            step = 1 << ((gram - have).bit_length() - 1)
            tail = power[step][have:]
            out = out[: len(tail)] * U64(pow(base, step, 1 << 64))
            out += tail[: len(out)]
            have += step
        out = out ^ (out >> U64(31))
        out *= U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Runs:
    """Runs of strings with one key in a chunk of documents, in order of (id, text)."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        ids = table.column("doc_id").combine_chunks()
        ids = ids.fill_null(LAST) if ids.null_count else ids
        self.ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.offsets = buffers(table.column("text"))
        found, at = [], 0
        n_docs = len(self.ids)
        while at < n_docs:
            end = int(np.searchsorted(self.offsets, self.offsets[at] + SLICE, side="right")) - 1
            end = min(max(end, at + 1), n_docs)
            found += self._of(at, end, width, gram)
            at = end
        empty = np.zeros(0, np.int64)
        self.doc, self.start, self.count, self.key = (np.concatenate(x) for x in zip(*found)) if found else (empty, empty, empty, np.zeros(0, U64))

    def _of(self, first: int, last: int, width: int, gram: int) -> Iterator[tuple]:
        """Pieces of at most SLICE string starts, so that a long document takes no more memory than others."""
        begin, end = int(self.offsets[first]), int(self.offsets[last])
        out = []
        for a in range(begin, end, SLICE):
            b = min(end, a + SLICE + width - 1)
            if b - a < width:
                continue
            key = window_minima(gram_hashes(self.data[a:b], gram), width - gram + 1)
            # strings end inside their document, so the last width - 1 positions of each start none
            inside = np.zeros(len(key) + 2, np.int32)
            low = np.clip(self.offsets[first:last] - a, 0, len(key))
            high = np.clip(self.offsets[first + 1 : last + 1] - width + 1 - a, 0, len(key))
            np.add.at(inside, low[high > low], 1)
            np.add.at(inside, high[high > low], -1)
            fits = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            change = np.concatenate([[True], key[1:] != key[:-1], [True]])
            new = np.flatnonzero(fits[:-1] & (change[:-1] | ~np.concatenate([[False], fits[:-2]])))
            last_of = np.flatnonzero(fits[:-1] & (change[1:] | ~fits[1:]))
            start = new + a
            out.append((np.searchsorted(self.offsets, start, side="right") - 1, start, last_of - new + 1, key[new]))
        return out


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel().astype(U64)


FORTY = U64((1 << 40) - 1)


def _bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> U64(40)) % U64(buckets)


class Chunk(Runs):
    """A chunk's distinct keys by bucket, and its runs that other documents may share."""

    def __init__(self, table: pa.Table, width: int, gram: int, buckets: int):
        order = pa.compute.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        super().__init__(self.table, width, gram)
        self.width, self.buckets = width, buckets
        short = self.key & FORTY
        self.bucket = _bucketed(self.key, buckets).astype(np.int64)
        # a run's place among the distinct (bucket, key) of the chunk
        joint = np.lexsort((short, self.bucket))
        s, b = short[joint], self.bucket[joint]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (b[1:] != b[:-1])]) if len(s) else np.zeros(0, bool)
        self.place = np.empty(len(s), np.int64)
        self.place[joint] = np.cumsum(new) - 1
        self.keys, self.key_bucket = s[new], b[new]
        n = len(self.keys)
        lo, hi = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(lo, self.place, self.ids[self.doc])
        np.maximum.at(hi, self.place, self.ids[self.doc])
        self.many = lo != hi
        self.edges = np.searchsorted(self.key_bucket, np.arange(buckets + 1))

    def key_rows(self):
        for b in range(self.buckets):
            part = slice(self.edges[b], self.edges[b + 1])
            if self.edges[b] < self.edges[b + 1]:
                yield b, _packed(self.keys[part]), np.packbits(self.many[part]).tobytes()

    def select(self, masks: dict[int, bytes]) -> None:
        """Keeps the runs whose key's bit is set, and finds the distinct ones: ``region`` by run."""
        shared = np.zeros(len(self.keys), bool)
        for b, raw in masks.items():
            n = self.edges[b + 1] - self.edges[b]
            shared[self.edges[b] : self.edges[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        chosen = np.flatnonzero(shared[self.place])
        self.doc, self.start, self.count, self.key, self.bucket = (x[chosen] for x in (self.doc, self.start, self.count, self.key, self.bucket))
        digest = self._digests()
        order = np.lexsort((self.ids[self.doc], self.count, digest, self.key, self.bucket))
        same = [x[order] for x in (self.count, digest, self.key, self.bucket)]
        new = np.zeros(len(order), bool)
        if len(order):
            new[0] = True
            for x in same:
                new[1:] |= x[1:] != x[:-1]
        self.region = np.empty(len(order), np.int64)
        self.region[order] = np.cumsum(new) - 1
        # the first run of a region has its smallest id
        self.first = order[new]
        self.region_bucket = self.bucket[self.first]

    def _digests(self) -> np.ndarray:
        """64-bit hashes of the runs' bytes, over slices of the data."""
        out = np.empty(len(self.start), U64)
        ends = self.start + self.count + self.width - 1
        at = 0
        while at < len(out):
            stop = int(np.searchsorted(self.start, self.start[at] + SLICE, side="right"))
            a, b = int(self.start[at]), int(ends[at:stop].max())
            out[at:stop] = span_hashes(self.data[a:b], self.start[at:stop] - a, ends[at:stop] - a)
            at = stop
        return out

    def region_rows(self):
        ends = self.start + self.count + self.width - 1
        edges = np.searchsorted(self.region_bucket, np.arange(self.buckets + 1))
        for b in range(self.buckets):
            part = self.first[edges[b] : edges[b + 1]]
            if len(part):
                text = b"".join([self.data[x:y].tobytes() for x, y in zip(self.start[part], ends[part])])
                yield b, self.key[part].tobytes(), self.ids[self.doc[part]].tobytes(), self.count[part].astype(np.int32).tobytes(), text

    def removed(self, bits: dict[int, bytes]) -> np.ndarray:
        """For each byte of the chunk, whether it goes."""
        counts = self.count[self.first]
        edges = np.searchsorted(self.region_bucket, np.arange(self.buckets + 1))
        begin = np.concatenate([[0], np.cumsum(counts)])
        flags = np.zeros(int(begin[-1]), bool)
        for b, raw in bits.items():
            x, y = begin[edges[b]], begin[edges[b + 1]]
            flags[x:y] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(y - x)).astype(bool)
        later = self.ids[self.doc] > self.ids[self.doc[self.first]][self.region] if len(self.doc) else np.zeros(0, bool)
        mark = np.zeros(len(self.data) + self.width, np.int32)
        place = begin[self.region] if len(self.region) else self.region
        upto = np.cumsum(self.count)
        at = 0
        while at < len(self.count):
            # strings of some runs, one after the other
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE)))
            count = self.count[at:stop]
            run = np.repeat(np.arange(at, stop), count)
            step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            goes = flags[place[run] + step] | later[run]
            mark[self.start[run[goes]] + step[goes] + self.width] = 1
            at = stop
        np.cumsum(mark, out=mark)
        # a byte goes if a removed string starts at one of the ``width`` positions up to it
        return mark[self.width :] > mark[: len(self.data)]


def shared_keys(rows: pa.Table) -> list[bytes]:
    """For each row of a bucket, a bit a key: whether another row has it too or it was marked."""
    parts = [_unpacked(r) for r in rows.column("keys").to_pylist()]
    marks = [np.unpackbits(np.frombuffer(r, np.uint8), count=len(p)).astype(bool) for r, p in zip(rows.column("many").to_pylist(), parts)]
    every = np.sort(np.concatenate(parts))
    repeated = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for p, m in zip(parts, marks):
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, p), len(repeated) - 1)
            m = m | (repeated[at] == p)
        out.append(np.packbits(m).tobytes())
    return out


def earlier_strings(rows: pa.Table, width: int) -> list[bytes]:
    """For each row of a bucket, a bit a string: whether a smaller id than its run's has it."""
    keys = [np.frombuffer(r, U64) for r in rows.column("keys").to_pylist()]
    n_rows = np.array([len(k) for k in keys])
    key = np.concatenate(keys)
    owner = np.concatenate([np.frombuffer(r, np.int64) for r in rows.column("ids").to_pylist()])
    count = np.concatenate([np.frombuffer(r, np.int32) for r in rows.column("counts").to_pylist()]).astype(np.int64)
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
    size = count + width - 1
    start = np.cumsum(size) - size
    begin = np.cumsum(count) - count
    flags = np.zeros(int(count.sum()), bool)
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
    weight = np.concatenate([[0], np.cumsum(size[order] + 1)])
    at = 0
    while at < len(edge) - 1:
        # whole keys, up to BLOCK bytes
        end = at + 1
        while end < len(edge) - 1 and weight[edge[end + 1]] - weight[edge[at]] <= BLOCK:
            end += 1
        part = order[edge[at] : edge[end]]
        flags_of(part, data, start, size, count, begin, owner, flags, width)
        at = end
    cut = np.cumsum(count)[np.cumsum(n_rows) - 1]
    return [np.packbits(f).tobytes() for f in np.split(flags, cut[:-1])]


def flags_of(part, data, start, size, count, begin, owner, flags, width) -> None:
    """Sorts the strings of some runs and sets the flags of those that a smaller id has."""
    # the runs' bytes one after the other, each closed by a zero byte
    length = size[part] + 1
    place = np.cumsum(length) - length
    text = np.zeros(int(length.sum()), np.uint8)
    n = int(size[part].sum())
    inside = np.arange(n) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
    text[np.repeat(place, size[part]) + inside] = data[np.repeat(start[part], size[part]) + inside]
    step = np.arange(int(count[part].sum())) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
    wanted = np.repeat(place, count[part]) + step
    slot = np.empty(len(text), np.int64)
    slot[wanted] = np.repeat(begin[part], count[part]) + step
    ids = np.empty(len(text), np.int64)
    ids[wanted] = np.repeat(owner[part], count[part])
    order, classes = prefix_classes(text, wanted, width)
    if not len(order):
        return
    own = ids[order]
    least = np.repeat(np.minimum.reduceat(own, classes), np.diff(np.append(classes, len(order))))
    flags[slot[order[least < own]]] = True


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), width: int = WIDTH, gram: int = GRAM, chunk_bytes: int = 32 << 20, least_bytes: int = 1 << 20, decode: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed [start, end) byte ranges), kept, and the columns of ``keep``.

    ``kept`` is binary; with ``decode`` it is text, without what is left of characters that were cut.
    """
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a chunk has one row a bucket, so their numbers follow the data as well as the partitions
    chunks = max(1, min(2 * partitions(spark), -(-total // least_bytes)), -(-total // chunk_bytes))
    buckets = min(2 * partitions(spark), chunks)
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))

    def chunk_of(key, table: pa.Table) -> Chunk:
        return Chunk(table, width, gram, buckets)

    def keys(key, table):
        c = chunk_of(key, table)
        rows = list(c.key_rows())
        names = ["bucket", "chunk", "keys", "many"]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=names)

    def answer_keys(key, rows):
        return pa.table([rows.column("chunk"), pa.array([key[0].as_py()] * rows.num_rows, pa.int32()), pa.array(shared_keys(rows), pa.binary())], names=["chunk", "bucket", "mask"])

    answers = "chunk int, bucket int, mask binary"
    # all passes are one query, so that the documents' exchange, and the keys', are made once and reused
    masks = dealt.groupBy("chunk").applyInArrow(tidy(keys), "bucket int, chunk int, keys binary, many binary").groupBy("bucket").applyInArrow(tidy(answer_keys), answers).withColumn("kind", F.lit(0))

    def by_bucket(rows, kind):
        return {b: m for b, m, k in zip(rows.column("bucket").to_pylist(), rows.column("mask").to_pylist(), rows.column("kind").to_pylist()) if k == kind}

    def regions(key, table, rows):
        out = []
        if table.num_rows:
            c = chunk_of(key, table)
            c.select(by_bucket(rows, 0))
            out = list(c.region_rows())
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        arrays = [pa.array(list(x), kind) for x, kind in zip(columns, kinds)]
        return pa.table([arrays[0], pa.array([key[0].as_py()] * len(out), pa.int32()), *arrays[1:]], names=["bucket", "chunk", "keys", "ids", "counts", "bytes"])

    def answer_regions(key, rows):
        return pa.table([rows.column("chunk"), pa.array([key[0].as_py()] * rows.num_rows, pa.int32()), pa.array(earlier_strings(rows, width), pa.binary())], names=["chunk", "bucket", "mask"])

    found = dealt.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(tidy_pair(regions), "bucket int, chunk int, keys binary, ids binary, counts binary, bytes binary").groupBy("bucket").applyInArrow(tidy(answer_regions), answers).withColumn("kind", F.lit(1))

    def cut(key, table, rows):
        if not table.num_rows:
            return pa.table([pa.array([], kind) for kind in (pa.int64(), pa.int64(), spans_type, kept_type)] + [table.column(f"keep_{c}") for c in keep], names=["doc_id", "n_bytes", "spans", "kept", *keep])
        c = chunk_of(key, table)
        c.select(by_bucket(rows, 0))
        gone = c.removed(by_bucket(rows, 1))
        spans, kept = [], []
        for a, b in zip(c.offsets[:-1], c.offsets[1:]):
            flags = gone[a:b]
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(c.data[a:b][~flags].tobytes())
            else:
                spans.append([])
                kept.append(c.data[a:b].tobytes())
        return pa.table([c.table.column("doc_id"), pa.array(np.diff(c.offsets)), pa.array(spans, spans_type), pa.array([k.decode("utf-8", "ignore") for k in kept] if decode else kept, kept_type)] + [c.table.column(f"keep_{k}") for k in keep], names=["doc_id", "n_bytes", "spans", "kept", *keep])

    kept_type = pa.string() if decode else pa.binary()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if decode else T.BinaryType())]
    schema = T.StructType(fields + [T.StructField(c, docs.schema[c].dataType) for c in keep])
    return dealt.groupBy("chunk").cogroup(masks.unionByName(found).groupBy("chunk")).applyInArrow(tidy_pair(cut), schema)
