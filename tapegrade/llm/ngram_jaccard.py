"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document's set holds the 64-bit hashes of its distinct ``width``-word shingles (of the whole sequence,
if it is shorter). Two sets link when 100 * intersection >= ``percent`` * union. All links between
different sets are found:

* Documents with the same set form a class before anything else is shuffled; one row stands for it, and the class has
  a number of its own, so that null and repeated ids name no class.
* Shingles have a total order: those of a bounded list of very frequent ones come last, by frequency,
  all others by hash. The order changes what the join costs, never what it finds. Sets that link
  share a shingle among their first ``n - ceil(percent * n / 100) + 1`` (the prefix).
* Classes with the same prefix and size form a group, and only groups are entered under the shingles of
  their prefix. Under each shingle, groups that no other group there fits by size and by the
  position of the shingle are dropped; the others are bound to the smallest group there, their hub. A shingle of the list that
  very many documents have is entered in parts, and each pair of parts meets on its own. Hashes of groups and shingles that
  collide bring more candidates together, never fewer.
* Each (hub, group) is expanded to (hub, member). Members carry no texts but the parity bits of their sets: two to four bits a shingle,
  each the parity of the shingles that fall on it. Bits that differ between two sets are at most as many as shingles that
  differ, so they bound the intersection from above, and pairs that cannot link are dropped without loss. A hub with many members is cut
  into blocks by hash. In each block, a few spanning forests of the pairs that are left, nearest first, are verified on the whole texts;
  a few pivots of the hub stand in all of its blocks and tie them together.
* Hubs of several blocks, and those with a pair that verification refused and another that no forest took, are searched again, by more
  forests each time: all members outside the hub's largest component against all members of other components, until nothing is
  left. (``similar_pairs`` verifies all pairs instead.)
* Components of the links come from alternating stars over checkpointed tables.

Texts thus move for pairs that nearly certainly link, a few times a member of a group of copies. All dealing into buckets follows measured
bytes, so a task holds some megabytes whatever the input.

Defined results: a null or empty text has an empty set, size 0, and a component of its own. A null id never
names a component: such a row takes the smallest id linked with it, or null, and links that run through it count. Rows that repeat an id are
judged by their texts. Rows with equal texts share a component. An empty table gives an empty one. Texts of any length are whole sets; one
text must fit a worker's memory. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapegrade.operators.graph import connected_components

from .common import LOWER, U64, buffers, buckets_for, kept, lean, mix, partitions, prepare, saved, sized, slices, span_hashes, tidy, word_spans

#: Very frequent shingles that are ordered last: at most so many, each in at least LOCAL documents of a slice.
FREQUENT, LOCAL = 1 << 16, 4
#: A shingle with more documents than this is entered in parts of about so many.
PART = 1 << 20
#: Members of a hub, or of a block of a large one, that are compared together, and bytes of their parity bits.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Members of a large hub that stand in all of its blocks.
PIVOTS = 8
#: Spanning forests of a first search, and how many times as many the next one takes.
FORESTS, MORE = 8, 32


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash), distinct and sorted."""
    low = LOWER[data]
    starts, ends, doc = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    n_docs = len(offsets) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    count = np.diff(first)
    with np.errstate(over="ignore"):
        joint = np.full(max(0, len(words) - width + 1), 0x51ED270B, U64)
        for k in range(width):
            joint = mix(joint * U64(0x9E3779B97F4A7C15) + words[k : k + len(joint)])
        whole = doc[: len(joint)] == doc[width - 1 :][: len(joint)]
        d, s = doc[: len(joint)][whole], joint[whole]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            value = mix(count[short].astype(U64) + U64(0xABCD))
            for k in range(width - 1):
                has = count[short] > k
                value[has] = mix(value[has] * U64(0x9E3779B97F4A7C15) + words[first[short[has]] + k])
            d, s = np.concatenate([d, short]), np.concatenate([s, value])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if len(d):
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
        d, s = d[new], s[new]
    return d, s


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles that many documents of a slice hold, rarest first, and how many rows were seen with each."""

    def count(batches):
        for b in batches:
            for part in slices(b, "text"):
                _, s = shingles(*buffers(part.column("text")), width)
                s = np.sort(s)
                at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(s)))
                many = n >= LOCAL
                yield pa.RecordBatch.from_arrays([pa.array(s[at[many]].view(np.int64)), pa.array(n[many].astype(np.int64))], names=["s", "n"])

    top = docs.select("text").mapInArrow(lean(count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    return top.column("s").to_numpy().view(U64)[::-1].copy(), top.column("n").to_numpy()[::-1].copy()


def ranks(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Place of frequent shingles in their order, from 1 on; 0 for all others."""
    if not len(frequent):
        return np.zeros(len(s), np.int64)
    by = np.argsort(frequent)
    at = np.minimum(np.searchsorted(frequent[by], s), len(frequent) - 1)
    return np.where(frequent[by][at] == s, by[at] + 1, 0)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their next ones, and so on: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(raw: bytes, width: int, kind) -> np.ndarray:
    wide = np.zeros((len(raw) // width, np.dtype(kind).itemsize), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return wide.view(kind).ravel()


def parity_bits(doc: np.ndarray, s: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per set, 64 bits or the power of two from 2n on; a bit is the parity of the shingles whose highest bits are its place."""
    power = np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum((np.int64(1) << power) >> 3)])
    # shingles are sorted within their set, so places are too
    place = (ends[:-1] * 8)[doc] + (s >> (64 - power[doc]).astype(U64)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    odd = place[new][np.diff(np.append(new, len(place))) % 2 == 1]
    out = np.zeros(int(ends[-1]), np.uint8)
    byte = odd >> 3
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else np.zeros(0, np.int64)
    if len(first):
        out[byte[first]] = np.add.reduceat(np.left_shift(1, odd & 7), first).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def folded(x: np.ndarray) -> np.ndarray:
    """Parity bits of half the width: neighbouring bits are added, the even ones of the sums moved together."""
    x = (x ^ (x >> U64(1))) & U64(0x5555555555555555)
    for k, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> U64(k))) & U64(mask)
    return x[:, 0::2] | (x[:, 1::2] << U64(32))


def fitting(n: np.ndarray, pos: np.ndarray, key: np.ndarray, percent: int) -> np.ndarray:
    """Which entries some other entry of the same key fits by size and position; keys are numbers from 0 on.

    Entries i and j fit if r = n - pos of both is at least percent / (100 + percent) of n_i + n_j, so if n_j <= u_i and n_i <= u_j
    for u = r (100 + percent) / percent - n. By size, the largest u up to a place, the entry's own left out, tells it.
    """
    u = np.maximum((100 + percent) * (n - pos) // percent - n, 0)
    order = np.lexsort((n, key))
    low, high = (key[order] << 34) + n[order], (key[order] << 34) + u[order]
    most = np.maximum.accumulate(high)
    second = np.maximum.accumulate(np.minimum(high, np.concatenate([[-1], most[:-1]])))
    last = np.searchsorted(low, high, side="right") - 1
    at = np.maximum(last, 0)
    best = np.where((np.arange(len(n)) <= last) & (most[at] == high), second[at], most[at])
    out = np.zeros(len(n), bool)
    out[order] = (best >= low) & (last >= 0)
    return out


class Bits:
    """Sets by their sizes and parity bits, and the pairs of them that may link."""

    def __init__(self, n: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.words = np.array([len(b) // 8 for b in bits], np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.table: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            self.rows[w] = np.flatnonzero(self.words == w)
            self.table[w] = np.frombuffer(b"".join([bits[k] for k in self.rows[w]]), U64).reshape(-1, w)

    def _side(self, w: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if w not in self.rows:
            return np.zeros(0, np.int64), np.zeros((0, w), U64)
        rows, table = self.rows[w], self.table[w]
        pick = np.flatnonzero(inside[rows])
        pick = pick[np.argsort(self.n[rows[pick]], kind="stable")]
        return rows[pick], table[pick]

    def pairs(self, left: np.ndarray, right: np.ndarray, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, bound of the similarity): pairs of a left and a right row whose bound reaches the threshold."""
        found = []
        for w in self.rows:
            a, x = self._side(w, left)
            for v in (w // 2, w, w * 2):
                b, y = self._side(v, right) if len(a) else (a, x)
                if not len(a) or not len(b):
                    continue
                p, q = (folded(x), y) if v < w else (x, folded(y)) if v > w else (x, y)
                found += self._near(a, p, b, q, allowed)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*found))

    def _near(self, a, x, b, y, allowed):
        n, m, percent = self.n[a], self.n[b], self.percent
        step = max(1, (2 << 20) // max(1, len(b) * x.shape[1]))
        for k in range(0, len(a), step):
            part = slice(k, min(len(a), k + step))
            # both sides are in order of size
            lo = int(np.searchsorted(m, -(-percent * n[part][0] // 100)))
            hi = int(np.searchsorted(m, 100 * n[part][-1] // percent, side="right"))
            if lo >= hi:
                continue
            apart = np.bitwise_count(x[part, None, :] ^ y[None, lo:hi, :]).sum(2, dtype=np.int64)
            total = n[part, None] + m[None, lo:hi]
            common = np.minimum((total - apart) // 2, np.minimum(n[part, None], m[None, lo:hi]))
            i, j = np.nonzero(linked(common, n[part, None], m[None, lo:hi], percent))
            r, c = a[part][i], b[lo:hi][j]
            keep = r != c
            if allowed is not None:
                keep &= allowed(r, c)
            if keep.any():
                i, j = i[keep], j[keep]
                yield r[keep], c[keep], common[i, j] / (total[i, j] - common[i, j])


def forests(a: np.ndarray, b: np.ndarray, weight: np.ndarray, count: int, times: int) -> np.ndarray:
    """Places of the edges of ``times`` spanning forests, each over what those before left, heaviest edges first.

    Of the edges across any cut of the graph, all are among them or ``times`` at least.
    """
    left = np.lexsort((b, a, -weight))
    out = []
    for _ in range(times):
        if not len(left):
            break
        taken = _forest(a[left], b[left], count)
        out.append(left[taken])
        left = np.delete(left, taken)
    return np.concatenate(out) if out else left


def _forest(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Places of a spanning forest of edges in order of weight: in each round every component takes its first edge."""
    up = np.arange(count)
    chosen = []
    live = np.arange(len(a))
    while True:
        ca, cb = up[a[live]], up[b[live]]
        apart = ca != cb
        live, ca, cb = live[apart], ca[apart], cb[apart]
        if not len(live):
            return np.unique(np.concatenate(chosen)) if chosen else live
        best = np.full(count, len(a))
        np.minimum.at(best, ca, live)
        np.minimum.at(best, cb, live)
        best = np.unique(best[best < len(a)])
        chosen.append(best)
        # edges are told apart by their places, so the chosen ones have no cycle
        while True:
            x, y = up[a[best]], up[b[best]]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(up, x, low)
            np.minimum.at(up, y, low)
            while (up[up] != up).any():
                up = up[up]


class Join:
    """The join's tables for one DataFrame of documents."""

    #: Spanning forests of a first search.
    forests = FORESTS

    def __init__(self, docs: DataFrame, percent: int = 85, width: int = 4, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, part: int = PART):
        self.spark = prepare(docs.sparkSession)
        self.percent, self.width, self.block, self.part = percent, width, block, part
        self.base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
        self.sets = saved(self._sets())
        # copies meet in partial results first: one row a class and task; a row stands for its class by (id, hash of the text)
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "size")).alias("rep")
        found = self.sets.filter("n > 0").groupBy("sig").agg(rep, F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits").alias("bits"))
        self.classes = saved(found.select(F.monotonically_increasing_id().alias("node"), "sig", "n", "gid", "bits", "rep.doc_id", "rep.th", "rep.size"))

    def _sets(self) -> DataFrame:
        width, percent = self.width, self.percent
        self.frequent, self.seen = frequent_shingles(self.base, width)
        frequent = self.frequent

        def run(batches):
            for b in batches:
                for part in slices(b, "text"):
                    yield rows(part)

        def rows(part):
            data, offsets = buffers(part.column("text"))
            doc, s = shingles(data, offsets, width)
            n_docs = part.num_rows
            edge = np.searchsorted(doc, np.arange(n_docs + 1))
            n = np.diff(edge)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(s ^ U64(seed)), dtype=U64)]) for seed in (0x1234567, 0x89ABCDEF01)]
                sig = np.column_stack([x[edge[1:]] - x[edge[:-1]] for x in sums])
            order = np.lexsort((s, ranks(s, frequent), doc))
            length = np.where(n > 0, prefix_length(n, percent), 0)
            place = np.arange(len(s)) - np.repeat(edge[:-1], n)
            prefix = s[order][place < np.repeat(length, n)]
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            with np.errstate(over="ignore"):
                # the same shingles in the shared order are the same prefix, whichever way they are summed
                run_sums = np.concatenate([[U64(0)], np.cumsum(mix(prefix ^ U64(0x77777)), dtype=U64)])
                gid = mix(run_sums[ends[1:]] - run_sums[ends[:-1]] + n.astype(U64))
            columns = {
                "doc_id": part.column("doc_id"), "th": part.column("th"), "size": pa.array(np.diff(offsets)), "n": pa.array(n), "sig": pa.array([r.tobytes() for r in sig], pa.binary()),
                "gid": pa.array(gid.view(np.int64)), "bits": parity_bits(doc, s, n), "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.view(np.int64))),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return self.base.mapInArrow(lean(run), "doc_id long, th long, size long, n long, sig binary, gid long, bits binary, prefix array<long>")

    def members(self) -> DataFrame:
        """(hub, node, n, bits): classes to be compared with each other, under each hub."""
        percent = self.percent
        entries = self.sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
        buckets = buckets_for(self.spark, 21 * entries)
        split = self.seen > self.part
        by = np.argsort(self.frequent[split])
        often, parts = self.frequent[split][by], -(-self.seen[split][by] // self.part)

        def post(batches):
            for b in batches:
                # a group's documents in one batch enter it once
                b = b.take(pa.array(np.unique(np.asarray(b.column("gid")), return_index=True)[1]))
                lists = b.column("prefix")
                n = np.asarray(b.column("n"))
                gid = np.asarray(b.column("gid"))
                values = np.asarray(lists.flatten()).view(U64)
                length = np.asarray(pa.compute.list_value_length(lists))
                owner = np.repeat(np.arange(len(length)), length)
                pos = np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
                if len(often) and len(values):
                    values, owner, pos = in_parts(values, owner, pos, gid)
                key = mix(values)
                bucket = (key >> U64(40)) % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                sorted_bucket = bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1], [True]])) if len(order) else np.zeros(1, np.int64)
                out = []
                for x, y in zip(edge[:-1], edge[1:]):
                    at = order[x:y]
                    out.append((int(sorted_bucket[x]), planes(key[at])[: 5 * len(at)], planes(gid[owner[at]]), planes(n[owner[at]].astype(np.int32)), planes(pos[at].astype(np.int32))))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int32()), *[pa.array(list(c), pa.binary()) for c in cols[1:]]], names=["bucket", "key", "gid", "n", "pos"])

        def in_parts(values, owner, pos, gid):
            """An entry under a very frequent shingle becomes one for each pair of its own part and another."""
            at = np.minimum(np.searchsorted(often, values), len(often) - 1)
            hit = often[at] == values
            times = np.where(hit, parts[at], 1)
            again = np.repeat(np.arange(len(values)), times)
            other = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            own = (gid[owner].view(U64) % times.astype(U64)).astype(np.int64)[again]
            pair = (np.minimum(own, other) * times[again] + np.maximum(own, other)).astype(U64)
            with np.errstate(over="ignore"):
                moved = np.where(hit[again], values[again] ^ mix(pair + U64(0x5EED)), values[again])
            return moved, owner[again], pos[again]

        def meet(_, rows):
            whole = lambda c, width, t: np.concatenate([unplaned(x, width, t) for x in rows.column(c).to_pylist()])
            key, gid, n, pos = whole("key", 5, U64), whole("gid", 8, np.int64), whole("n", 4, np.int32).astype(np.int64), whole("pos", 4, np.int32).astype(np.int64)
            order = np.lexsort((pos, n, gid, key))
            key, gid, n, pos = (x[order] for x in (key, gid, n, pos))
            # equal entries are one; entries that differ in anything stay, should two groups have one hash
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (gid[1:] != gid[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])])
            key, gid, n, pos = (x[new] for x in (key, gid, n, pos))
            number = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            keep = fitting(n, pos, number, percent)
            number, gid = number[keep], gid[keep]
            if not len(gid):
                return pa.table([pa.array([], pa.int64())] * 2, names=["hub", "gid"])
            first = np.concatenate([[True], number[1:] != number[:-1]])
            hub = np.minimum.reduceat(gid, np.flatnonzero(first))[np.cumsum(first) - 1]
            order = np.lexsort((gid, hub))
            hub, gid = hub[order], gid[order]
            new = np.concatenate([[True], (hub[1:] != hub[:-1]) | (gid[1:] != gid[:-1])])
            return pa.table([pa.array(hub[new]), pa.array(gid[new])], names=["hub", "gid"])

        found = self.sets.filter("n > 0").select("gid", "n", "prefix").mapInArrow(lean(post), "bucket int, key binary, gid binary, n binary, pos binary").groupBy("bucket").applyInArrow(tidy(meet), "hub long, gid long")
        # a group's own members share their prefix, so they are candidates of each other
        several = self.classes.groupBy("gid").agg(F.count("*").alias("members")).filter("members > 1")
        found = found.unionByName(several.select(F.col("gid").alias("hub"), "gid")).distinct()
        return found.join(self.classes.select("gid", "node", "n", "bits"), "gid").select("hub", "node", "n", "bits")

    def _cells(self, cells: DataFrame, times: int | None) -> DataFrame:
        """(hub, a, b, more): pairs of each cell (hub, i, j) that may link, and whether the cell has others.

        Rows of side 0 meet those of side 1, or each other in a cell without side 1. All pairs (None), or else the edges of so many spanning
        forests over what is known of the rows' components; pairs in ``no`` are left out.
        """
        percent = self.percent
        buckets = buckets_for(self.spark, cells.agg(F.sum(F.octet_length("bits") + 64)).first()[0] or 0)
        dealt = cells.withColumn("bucket", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(buckets)).cast("int"))

        def compare(_, rows):
            hub, i, j, side, node, n, comp = (rows.column(c).to_numpy() for c in ("hub", "i", "j", "side", "node", "n", "comp"))
            order = np.lexsort((node, side, j, i, hub))
            hub, i, j, side, node, n, comp = (x[order] for x in (hub, i, j, side, node, n, comp))
            bits, no = rows.column("bits"), rows.column("no")
            edge = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
            out = [[*[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)]]
            for x, y in zip(edge[:-1], edge[1:]):
                if y - x < 2:
                    continue
                at = order[x:y]
                sets = Bits(n[x:y], bits.take(pa.array(at)).to_pylist(), percent)
                first, own, names = side[x:y] == 0, comp[x:y], node[x:y]
                refused = {(a, b) for a, others in zip(names.tolist(), no.take(pa.array(at)).to_pylist()) for b in others or ()}
                if first.all():
                    a, b, w = sets.pairs(first, first, lambda r, c: (names[r] < names[c]) & (own[r] != own[c]))
                else:
                    a, b, w = sets.pairs(first, ~first, lambda r, c: (names[r] != names[c]) & (own[r] != own[c]))
                    # a pair of two rows of side 0 comes both ways
                    both = np.unique(np.column_stack([np.minimum(names[a], names[b]), np.maximum(names[a], names[b])]), axis=0, return_index=True)[1]
                    a, b, w = a[both], b[both], w[both]
                if refused and len(a):
                    fresh = np.array([(p, q) not in refused for p, q in zip(names[a].tolist(), names[b].tolist())])
                    a, b, w = a[fresh], b[fresh], w[fresh]
                have = len(a)
                if times and have:
                    label, number = np.unique(own, return_inverse=True)
                    keep = forests(number[a], number[b], w, len(label), times)
                    a, b = a[keep], b[keep]
                out.append([np.full(len(a), hub[x]), np.minimum(names[a], names[b]), np.maximum(names[a], names[b]), np.full(len(a), len(a) < have)])
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["hub", "a", "b", "more"])

        return dealt.groupBy("bucket").applyInArrow(tidy(compare), "hub long, a long, b long, more boolean")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, links) of distinct pairs, by the shingles of their texts."""
        percent, width = self.percent, self.width
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("pieces"))
        placed = pairs.join(many, "a").withColumn("piece", F.pmod(F.xxhash64("b"), "pieces").cast("int"))
        routes = placed.select("a", "piece", F.col("b").alias("node")).unionByName(placed.select("a", "piece", F.col("a").alias("node")).distinct())
        routes, count = kept(routes.join(self.classes.select("node", "doc_id", "th", "size"), "node").select("a", "piece", "node", F.col("doc_id").alias("id"), F.col("th").alias("h"), "size"))
        buckets = buckets_for(self.spark, routes.agg(F.sum("size")).first()[0] or 0)
        met = self.base.join(sized(routes, count, 48), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")))
        met = met.select(F.pmod(F.xxhash64("a", "piece"), F.lit(buckets)).cast("int").alias("bucket"), "a", "piece", "node", "text")

        def verify(_, rows):
            a, piece, node = (rows.column(c).to_numpy() for c in ("a", "piece", "node"))
            order = np.lexsort((node, node != a, piece, a))
            a, piece, node = (x[order] for x in (a, piece, node))
            # a row that the table repeats came several times
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1]) | (node[1:] != node[:-1])])
            order, a, piece, node = (x[new] for x in (order, a, piece, node))
            edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (piece[1:] != piece[:-1]), [True]]))
            out = []
            for x, y in zip(edge[:-1], edge[1:]):
                doc, s = shingles(*buffers(rows.column("text").take(pa.array(order[x:y]))), width)
                n = np.bincount(doc, minlength=y - x)
                own = s[: n[0]]
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                common = np.bincount(doc[own[at] == s], minlength=y - x)
                good = linked(common, n, n[0], percent)
                out += list(zip([int(a[x])] * (y - x - 1), node[x + 1 : y].tolist(), good[1:].tolist()))
            a, b, good = zip(*out) if out else ([], [], [])
            return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], names=["a", "b", "links"])

        return met.groupBy("bucket").applyInArrow(tidy(verify), "a long, b long, links boolean")

    def _search(self, cells: DataFrame, times: int | None) -> tuple[DataFrame, DataFrame]:
        """Pairs found by hub, and the distinct ones verified."""
        found = kept(self._cells(cells, times))[0]
        return found, kept(self._verified(found.select("a", "b").distinct()))[0]

    def links(self, every: bool = False) -> DataFrame:
        """(a, b): links between classes, by their numbers; enough to span each component, or ``every`` one."""
        members = saved(self.members())
        bytes_ = F.sum(F.octet_length("bits"))
        parts = F.greatest(F.ceil(F.count("*") / self.block), F.ceil(bytes_ / BLOCK_BYTES)).cast("int")
        large, several = kept(members.groupBy("hub").agg(parts.alias("parts")).filter("parts > 1"))
        placed = members.join(sized(large, several, 16), "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        plain = [F.lit(0).alias("side"), "node", "n", "bits"]
        unknown = [F.col("node").alias("comp"), F.lit(None).cast("array<long>").alias("no")]
        if every:
            other = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cells = other.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "bits", *unknown)
            return self._search(cells, None)[1].filter("links").select("a", "b")
        cells = placed.select("hub", own.alias("i"), own.alias("j"), *plain, *unknown)
        if several:
            pivot = placed.filter("parts > 1").groupBy("hub", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS)).alias("p")).agg(F.min(F.struct("node", "n", "bits")).alias("m"), F.first("parts").alias("parts"))
            pivot = pivot.select("hub", "m.*", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at")).filter(own != F.col("at"))
            cells = cells.unionByName(pivot.select("hub", F.col("at").alias("i"), F.col("at").alias("j"), *plain, *unknown))
        times = self.forests
        found, checked = self._search(cells, times)
        tested, again = checked, large.select("hub")
        while True:
            # a hub of one block is done if nothing was refused, or nothing left out
            refused = found.filter("more").join(checked.filter("NOT links"), ["a", "b"]).select("hub")
            again, count = kept(again.unionByName(refused).distinct())
            if not count:
                return tested.filter("links").select("a", "b")
            times *= MORE
            found, checked = self._search(self._rest(members, sized(again, count, 8), tested), times)
            tested, again = kept(tested.unionByName(checked))[0], again.limit(0)

    def _rest(self, members: DataFrame, hubs: DataFrame, tested: DataFrame) -> DataFrame:
        """Cells of the hubs to be searched again: members outside a hub's largest component against all others."""
        roots = connected_components(tested.filter("links").select("a", "b"))
        refused = tested.filter("NOT links")
        no = refused.unionByName(refused.select(F.col("b").alias("a"), F.col("a").alias("b"), "links")).groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("no"))
        rows = kept(members.join(hubs, "hub").join(roots, "node", "left").select("hub", "node", "n", "bits", F.coalesce("root", "node").alias("comp")))[0]
        sizes = rows.groupBy("hub", "comp").agg(F.count("*").alias("k"), F.sum(F.octet_length("bits")).alias("size"))
        parts = lambda k, size: F.greatest(F.lit(1), F.ceil(k / self.block), F.ceil(size / BLOCK_BYTES)).cast("int")
        largest = F.max(F.struct("k", "comp", "size"))
        whole = sizes.groupBy("hub").agg(largest.alias("top"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
        whole, count = kept(whole.select("hub", F.col("top.comp").alias("giant"), parts(F.col("k"), F.col("size")).alias("all"), parts(F.col("k") - F.col("top.k"), F.col("size") - F.col("top.size")).alias("few")))
        rows = rows.join(sized(whole, count, 32), "hub")
        own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = rows.filter("comp <> giant").join(no, "node", "left").select("hub", own("few").alias("i"), each("all").alias("j"), F.lit(0).alias("side"), "node", "n", "bits", "comp", "no")
        right = rows.select("hub", each("few").alias("i"), own("all").alias("j"), F.lit(1).alias("side"), "node", "n", "bits", "comp", F.lit(None).cast("array<long>").alias("no"))
        return left.unionByName(right)

    def components(self, rows: bool = False) -> DataFrame:
        """doc_id, n_shingles and component_id of every row; with ``rows`` also th (the hash of its text) and root (its component's number, null without shingles)."""
        roots = connected_components(self.links())
        ids = roots.join(self.classes.select("node", "doc_id"), "node")
        least = ids.groupBy("root").agg(F.min("doc_id").alias("component"))
        found = roots.join(least, "root").select("node", "root", "component")
        named = self.classes.select("node", "sig", "doc_id").join(found, "node", "left").select("sig", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("root", "node").alias("root"))
        met = self.sets.select("doc_id", "th", "n", "sig").join(named, "sig", "left")
        of = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("component_id")
        return met.select("doc_id", F.col("n").alias("n_shingles"), of, *(["th", "root"] if rows else []))


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, **names) -> DataFrame:
    return Join(docs, percent, width, **names).components()


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay when one of each component does; the id is ``doc_id``, the text ``text``.

    The row of the smallest id stays, of that id's rows the one whose text has the smallest hash, and of equal (id, text) the first by its
    other columns, so the order of the input decides nothing. Rows that repeat an id but not a text are judged by their texts. Of rows
    without shingles, one of each id stays. Rows without an id have no name to stay under for others, so all of them stay.
    """
    found = Join(docs, percent, width).components(rows=True).filter("doc_id IS NOT NULL")
    group = F.struct("root", F.when(F.col("root").isNull(), F.col("doc_id")).alias("own"))
    keep = found.groupBy(group.alias("g")).agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"))
    named = docs.filter("doc_id IS NOT NULL").withColumn("_h", F.xxhash64("text"))
    met = named.join(keep, (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_th")), "left_semi")
    rest = [F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]))] if len(docs.columns) > 2 else []
    place = F.row_number().over(W.partitionBy("doc_id", "_h").orderBy("doc_id", *rest))
    return met.withColumn("_k", place).filter("_k = 1").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def similar_pairs(docs: DataFrame, percent: int = 85, width: int = 4, **names) -> tuple[DataFrame, DataFrame]:
    """(all links between classes, membership of rows in classes); a class is named by its smallest id."""
    join = Join(docs, percent, width, **names)
    member = join.sets.select("doc_id", "n", "sig").join(join.classes.select("sig", F.col("doc_id").alias("rep")), "sig", "left")
    name = lambda end: join.classes.select(F.col("node").alias(end), F.col("doc_id").alias(f"{end}_id"))
    links = join.links(every=True).join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return links, member.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"))
