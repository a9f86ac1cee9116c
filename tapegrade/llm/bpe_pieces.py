"""Exact merge-type encoding of SentencePiece BPE models by backtracking, and decoding.

A BPE encoding is the only split of a text into vocabulary pieces in which every piece and every
adjacent pair is *compatible*: re-merging the pair's characters by score gives back the same two
pieces. The encoder walks from left to right. At each position it takes the longest piece that an
Aho-Corasick automaton finds there, moves to the next shorter one when the pair with the previous
piece is not compatible, and, when none is left, marks the position in a bitfield of failed positions
and steps back. A position that failed is never entered again, so the walk is linear in practice.
Pair checks re-merge two pieces once and are remembered.

Characters outside the vocabulary become byte pieces and split the text, as no merge crosses them. The
space mark only starts pieces (or fills them), so no merge crosses from another character to a
space mark either; the text is cut there (and around line feeds, where they are outside the vocabulary), and the encoding of
each cut, mostly one word, is remembered in two bounded tables: when the newer one is full it becomes the older one, and cuts
that are met again move to the newer. The new cuts of a slice of text go through the same walk in lockstep (``Lockstep``): the automaton's
goto table, the pair checks and the bitfields are arrays, and each step moves all cuts on by one try. Cuts with
rare characters, or of more than 64, take the walk one by one. Whole texts are encoded, whatever their length.

Defined results: null counts as the empty text, which has no ids and decodes to the empty text. Rows are
encoded one by one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from contextlib import contextmanager

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import HELD, prepare, release, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Cuts remembered by one worker in each of two tables, and the longest one remembered.
MEMORY, LONGEST = 100_000, 64
#: Checked pairs remembered beside those of ``Lockstep``; bytes of text whose cuts are held at once; cuts that are learned at once.
PAIRS, SLICE, LEARNED = 1 << 17, 1 << 18, 20_000
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if m.trainer_spec.model_type != pb.TrainerSpec.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in m.pieces):
        raise ValueError("this encoder takes BPE models with an identity normaliser, a leading space mark, and no user-defined or unused pieces")
    return [(p.piece, p.score, p.type) for p in m.pieces], {"dummy": n.add_dummy_prefix, "unk": m.trainer_spec.unk_id, "bytes": m.trainer_spec.byte_fallback, "surface": m.trainer_spec.unk_surface}


class Memory(dict):
    """By cut: its ids as text, joined by commas. No more than ``MEMORY`` cuts, and as many older ones."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, str] = {}

    def clear(self) -> None:
        super().clear()
        self.older = {}

    def _make_room(self, cuts: int) -> None:
        if len(self) + cuts > MEMORY:
            self.older = dict(self)
            super().clear()

    def learn(self, cuts: set[str]) -> None:
        """Takes in the new ones of at most ``MEMORY`` cuts, in lockstep where that is possible."""
        e = self.encoder
        self._make_room(len(cuts - self.keys()))
        new = []
        for c in cuts - self.keys():
            if (found := self.older.get(c)) is not None:
                self[c] = found
            elif len(c) <= LONGEST and e.lockstep.chars.issuperset(c):
                new.append(c)
        for k in range(0, len(new), LEARNED):
            part = new[k : k + LEARNED]
            for cut, ids in zip(part, e.lockstep.encode(part)):
                self[cut] = ",".join([e.shown[i] for i in ids])

    def __missing__(self, cut: str) -> str:
        found = self.older.get(cut)
        if found is None:
            found = ",".join(map(str, self.encoder.cut_ids(cut)))
        if len(cut) <= LONGEST:
            self._make_room(1)
            self[cut] = found
        return found

    def of(self, cuts: list[str]) -> list[str]:
        """The ids of each cut, in order; no more cuts are learned at once than are held."""
        out: list[str] = []
        for k in range(0, len(cuts), MEMORY):
            part = cuts[k : k + MEMORY]
            self.learn(set(part))
            out += [self[c] for c in part]
        return out


class Encoder:
    def __init__(self, path: str):
        self.pieces, self.spec = read_model(path)
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.kinds = [kind for _, _, kind in self.pieces]
        self.ordinary = 1 + max(i for i, kind in enumerate(self.kinds) if kind != NORMAL)
        self.score = [s for _, s, _ in self.pieces]
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        # a cut before each run of marks is safe only if no piece crosses it
        # line feeds outside the vocabulary split the text in any case, so words beside them are cuts of their own
        self.cut = None if crossing else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if any("\n" in p for p in self.ids) else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, tuple[int, ...]] = {}
        whole = [i for p, i in self.ids.items() if self.merge(p) == [i]]
        names = {self.pieces[i][0]: i for i in whole}
        self.names = names
        for p, i in names.items():
            self.automaton.add_word(p, i)
            self.shorter[i] = (i, *(names[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in names))
        self.automaton.make_automaton()
        self.trie = self.automaton.longest_prefix
        self.widest = max(map(len, names))
        self.size = [len(p) if i else 0 for i, (p, _, _) in enumerate(self.pieces)]
        self.known = {p for p in self.ids if len(p) == 1}
        self.plain = [p.replace(MARK, " ") for p, _, _ in self.pieces]
        self.shown = [str(i) for i in range(len(self.pieces))]
        # what ids say by themselves: plain pieces, and bytes of ASCII, which are never part of a longer sequence
        self.read = dict(zip(self.shown[self.ordinary :], self.plain[self.ordinary :])) | {self.shown[i]: chr(b) for i, b in self.byte_of.items() if b < 128}
        self.lockstep = Lockstep(self)
        self.memory = Memory(self)

    def merge(self, text: str) -> list[int]:
        """Plain merging by best score, leftmost first: the definition that the walk must meet."""
        if any(c not in self.ids for c in text):
            return [-1]
        n = len(text)
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-self.score[i], k, text[k : k + 2]) for k in range(n - 1) if (i := self.ids.get(text[k : k + 2])) is not None]
        heapq.heapify(heap)

        def push(k, m):
            i = self.ids.get(part[k] + part[m])
            if i is not None:
                heapq.heappush(heap, (-self.score[i], k, part[k] + part[m]))

        while heap:
            _, k, made = heapq.heappop(heap)
            m = after[k] if part[k] else n
            if m >= n or part[k] + part[m] != made:
                continue
            part[k], part[m] = made, ""
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
                push(k, after[k])
            if before[k] >= 0:
                push(before[k], k)
        return [self.ids[p] for p in part if p]

    def pair(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            found = self.compatible[key] = self.merge(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return found

    def longest(self, text: str, at: int) -> int:
        """The longest piece that starts at a position: the automaton's trie bounds its length."""
        part = text[at : at + self.widest]
        part = part[: self.trie(part)]
        while (i := self.names.get(part)) is None:
            part = part[:-1]
        return i

    def walk(self, text: str) -> list[int]:
        """Encodes text of known characters by backtracking."""
        n, size, shorter, pairs, many = len(text), self.size, self.shorter, self.compatible, len(self.pieces)
        failed = bytearray((n >> 3) + 1)
        ids: list[int] = []
        left: list[tuple[int, ...]] = []  # by piece taken, the shorter ones not tried yet
        at, last, choices = 0, -1, shorter[self.longest(text, 0)]
        while True:
            for k, i in enumerate(choices):
                end = at + size[i]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if last >= 0:
                    fits = pairs.get(last * many + i)
                    if not (self.pair(last, i) if fits is None else fits):
                        continue
                ids.append(i)
                if end == n:
                    return ids
                left.append(choices[k + 1 :])
                at, last, choices = end, i, shorter[self.longest(text, end)]
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= size[ids.pop()]
                last = ids[-1] if ids else -1
                choices = left.pop()

    def cut_ids(self, text: str) -> list[int]:
        """Ids of one cut; unknown characters become bytes (or the unknown piece)."""
        if self.known.issuperset(text):
            return self.walk(text)
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if start < k:
                    out += self.walk(text[start:k])
                out += [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.spec["bytes"] else [self.spec["unk"]]
                start = k + 1
        if start < len(text):
            out += self.walk(text[start:])
        return out

    def normal(self, text: str) -> str:
        if not text:
            return ""
        return (MARK if self.spec["dummy"] else "") + text.replace(" ", MARK)

    def cuts(self, text: str) -> list[str]:
        text = self.normal(text)
        return self.cut.findall(text) if self.cut else [text] if text else []

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for said in self.memory.of(self.cuts(text or "")) for i in said.split(",")]

    def encode_each(self, batch: pa.RecordBatch):
        """The ids of each text of a batch, as text joined by commas, a slice of the texts at a time."""
        for part in slices(batch, "text", SLICE):
            cuts = [self.cuts(t or "") for t in part.column("text").to_pylist()]
            said = self.memory.of([c for one in cuts for c in one])
            at = 0
            for one in cuts:
                yield ",".join(said[at : at + len(one)])
                at += len(one)

    def decode_shown(self, said: str) -> str:
        """Text of ids that are given as text joined by commas."""
        ids = said.split(",") if said else []
        try:
            out = "".join([self.read[i] for i in ids])
        except KeyError:  # longer sequences of bytes, and pieces of other kinds
            return self.decode([int(i) for i in ids])
        return out[1:] if self.spec["dummy"] and ids and self.pieces[int(ids[0])][0].startswith(MARK) else out

    def decode(self, ids) -> str:
        """Text of ids: marks are spaces, the one that opens the text is dropped, runs of byte pieces are UTF-8."""
        out: list[str] = []
        pending = bytearray()
        first = True

        def flush():
            if pending:
                out.append(utf8(bytes(pending)))
                pending.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(self.byte_of[i])
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.spec["surface"])
                first = False
                continue
            piece = self.pieces[i][0]
            if first and self.spec["dummy"] and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)


def utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is no part of a valid sequence gives one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class Lockstep:
    """The walk over many short cuts at once."""

    SLOTS = 21  # log2 of the direct-mapped table of checked pairs

    def __init__(self, e: Encoder, classes: int = 160):
        self.e = e
        # characters by how many pieces hold them; the first ``classes`` have a column of the goto table
        held: dict[str, int] = {}
        for p in e.names:
            for c in p:
                held[c] = held.get(c, 0) + 1
        common = [c for c in sorted(held, key=lambda c: (-held[c], c)) if c in e.known and ord(c) < 0x10000][:classes]
        self.chars = frozenset(common)
        self.column = np.full(0x10000, -1, np.int16)
        for k, c in enumerate(common):
            self.column[ord(c)] = k
        nodes: list[dict[str, int]] = [{}]
        piece = [0]
        for p, i in e.names.items():
            if not self.chars.issuperset(p):
                continue
            at = 0
            for c in p:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                    piece.append(0)
                at = nodes[at][c]
            piece[at] = i
        self.goto = np.zeros((len(nodes), len(common)), np.int32)  # 0: no such node
        for at, to in enumerate(nodes):
            for c, n in to.items():
                self.goto[at, self.column[ord(c)]] = n
        self.piece = np.array(piece, np.int32)
        many = len(e.pieces)
        self.size = np.array(e.size, np.int64)
        self.shorter = np.zeros(many, np.int32)  # the next shorter piece that a piece starts with; 0: none
        for i, chain in e.shorter.items():
            self.shorter[i] = chain[1] if len(chain) > 1 else 0
        self.pairs = np.full(1 << self.SLOTS, -1, np.int64)  # pair * 2 + whether compatible

    def longest(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest piece from each position on, up to the end of its cut."""
        column = self.column[codes]
        node = np.zeros(len(codes), np.int32)
        best = np.zeros(len(codes), np.int32)
        live = np.arange(len(codes))
        depth = 0
        while len(live):
            node[live] = self.goto[node[live], column[live + depth]]
            found = self.piece[node[live]]
            best[live[found > 0]] = found[found > 0]
            depth += 1
            live = live[(node[live] > 0) & (live + depth < ends[live])]
        return best

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.e.pieces) + b
        slot = (key * 2654435761 >> 11) & ((1 << self.SLOTS) - 1)
        held = self.pairs[slot]
        known = held >> 1 == key
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            fits = np.array([self.e.pair(*divmod(int(k), len(self.e.pieces))) for k in new], np.int64)[back]
            self.pairs[slot[~known]] = key[~known] * 2 + fits
            out = (held & 1).astype(bool)
            out[~known] = fits.astype(bool)
            return out
        return (held & 1).astype(bool)

    def encode(self, cuts: list[str]) -> list[list[int]]:
        """Ids of cuts of at most 64 of the common characters each."""
        n = np.array([len(c) for c in cuts], np.int64)
        codes = np.frombuffer("".join(cuts).encode("utf-16-le"), np.uint16)
        begin = np.cumsum(n) - n
        best = self.longest(codes, np.repeat(begin + n, n))
        many = len(cuts)
        taken = np.zeros((many, int(n.max())), np.int32)
        depth, at = np.zeros(many, np.int64), np.zeros(many, np.int64)
        failed = np.zeros(many, np.uint64)  # bit k: no way on from position k; position 64 is never marked
        tried = best[begin].copy()
        live = np.arange(many)
        one = np.uint64(1)
        while len(live):
            i = tried[live]
            none = i == 0
            # out of pieces: mark the position, step back, and go on with the next shorter piece there
            back = live[none]
            failed[back] |= one << at[back].astype(np.uint64)
            depth[back] -= 1
            last = taken[back, depth[back]]
            at[back] -= self.size[last]
            tried[back] = self.shorter[last]
            go, i = live[~none], i[~none]
            end = at[go] + self.size[i]
            whole = end == n[go]
            fits = whole | (failed[go] >> np.minimum(end, 63).astype(np.uint64) & one == 0)
            inner = fits & (depth[go] > 0)
            fits[inner] = self.compatible(taken[go[inner], depth[go[inner]] - 1], i[inner])
            yes = go[fits]
            taken[yes, depth[yes]] = i[fits]
            depth[yes] += 1
            at[yes] = end[fits]
            more = yes[~whole[fits]]
            tried[more] = best[begin[more] + at[more]]
            no = go[~fits]
            tried[no] = self.shorter[i[~fits]]
            live = live[at[live] < n[live]]
        return [row[:d] for row, d in zip(taken.tolist(), depth.tolist())]


_encoders: dict[str, Encoder] = HELD.setdefault("bpe_pieces", {})


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@contextmanager
def at_work(path: str):
    """The worker's encoder for one partition; what it remembers of cuts goes at the end, as idle workers would hold it."""
    release("bpe_pieces")
    e = encoder(path)
    try:
        yield e
    finally:
        e.memory.clear()
        release("bpe_pieces")


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        with at_work(model) as e:
            for b in batches:
                lists = [np.array(said.split(","), np.int32) if said else [] for said in e.encode_each(b)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""
    prepare(encoded.sparkSession)

    def run(batches):
        e = encoder(model)
        for b in batches:
            ids, lists = b.columns
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([e.decode(x or []) for x in lists.to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every row and returns digests of both, without moving the ids between processes."""
    prepare(docs.sparkSession)

    def digests(e: Encoder, said: str):
        return said.count(",") + 1 if said else 0, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(e.decode_shown(said).encode()).hexdigest()

    def run(batches):
        with at_work(model) as e:
            for b in batches:
                rows = [digests(e, said) for said in e.encode_each(b)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=SCHEMA.names)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
