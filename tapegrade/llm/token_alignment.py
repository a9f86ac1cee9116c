"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often the corpus links two ids.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (pieces, which adds the space itself) the text, both without special tokens; their
strings inside a text are plain text.

1. Inside ``mapInPandas``, two pointers walk over the cumulative token ends of A and B, the steps of a batch at once: the pointer whose token ends
   first moves on, each step is one link (two tokens whose byte ranges overlap), and a step at which both end closes a group.
2. A text is cut before a space between two characters that are no white space. A's pattern never crosses such a place, nor does any piece of B
   (checked when the model is read; if one did, texts would stay whole), so both encodings of the whole are those of its segments, one
   after the other, and groups end at cuts. Segments are encoded and merged when first met; a worker drops what it remembers beyond REMEMBERED segments or
   sixteen times as many links, and at a partition's end. Segments above SHORT characters are not found again. Printable ASCII is encoded from the ranks of
   A's vocabulary, all else by the library that the file is for.
3. Spark counts the documents of each id pair (``groupBy``, partial counts first), takes the maximum of each A id (at most as
   many rows as the vocabulary), and joins counts and maxima back to the documents' links by the pair. The side of the counts is broadcast only below
   8 MB by its own count; beyond that the join is sorted and merged, and adaptive execution splits pairs that most documents hold.

Ids of a pair are one whole number, a * (size of B) + b. Documents are told apart by a number of their own, not by their ids, so null and repeated ids
count as documents of their own.

Defined results: a null or empty text, or one whose joined tokens differ from the bytes of space + text, has no tokens: zeros and an empty
digest. An empty table gives an empty one. Texts of any length are whole; a text and its tokens must fit a worker's memory. Columns other than the id and
the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_pieces import MARK
from .common import HELD, kept, prepare, release, saved, sized

#: Segments that a worker remembers, and how long they may be.
REMEMBERED, SHORT = 1 << 17, 64
#: A segment: from a space up to the next space that stands between two characters that are no white space.
SEGMENT = re.compile(r" \S+(?= \S|\Z)| .*?\S(?= \S|\Z)| .*", re.DOTALL)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B, whether a group ends) of each link: where two pointers over the cumulative ends stand at each step.

    All steps at once: each distinct end is a step, and a pointer stands at its first token that does not end before it.
    """
    ends = np.union1d(ends_a, ends_b)
    i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return i, j, ends_a[i] == ends_b[j]


#: The byte-level pattern, which both libraries apply alike to printable ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Rows:
    """What is known of segments: sizes, groups as text, and id pairs in one flat array."""

    def __init__(self):
        self.n = 0
        self.sizes = np.zeros((1024, 4), np.int64)  # tokens of A, of B, groups; whether the bytes agree
        self.said: list[str] = []
        self.start = np.zeros(1025, np.int64)
        self.pairs = np.zeros(4096, np.int64)

    def add(self, sizes: np.ndarray, said: list[str], lengths: np.ndarray, pairs: np.ndarray) -> None:
        n, end = self.n + len(sizes), self.start[self.n] + len(pairs)
        if n > len(self.sizes):
            self.sizes, self.start = np.resize(self.sizes, (2 * n, 4)), np.resize(self.start, 2 * n + 1)
        if end > len(self.pairs):
            self.pairs = np.resize(self.pairs, 2 * end)
        self.sizes[self.n : n], self.pairs[self.start[self.n] : end] = sizes, pairs
        self.start[self.n + 1 : n + 1] = self.start[self.n] + np.cumsum(lengths)
        self.said += said
        self.n = n


class Aligner:
    """Both tokenizers, and the segments met so far. In the text of groups, ``sides`` parts a group's ids of A from those of B, ``between`` parts groups."""

    def __init__(self, byte_level: str, pieces: str, sides: str = ";", between: str = "|"):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_of_character()
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in spec["model"]["vocab"].items():
            if all(c in to_byte for c in token):
                self.bytes_a[i] = bytes(to_byte[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.size_b))]
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # each id as text, followed by a comma or by what ends its side of a group
        self.text_a = [f"{i}{end}" for i in range(self.size_a) for end in (",", sides)]
        self.text_b = [f"{i}{end}" for i in range(self.size_b) for end in (",", between, "")]
        self.between = between
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        crossing = any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.size_b) if not self.b.is_control(i))
        self.segments = SEGMENT.findall if plain and not crossing else lambda text: [text]
        self.ranked = self._ranked(spec) if plain else None
        self.memory: dict[str, int] = {}
        self.forget()

    def _ranked(self, spec: dict):
        """The same vocabulary as ranks, which encodes faster, if the order of its merges is that of its ids."""
        import tiktoken

        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or any(len(self.bytes_a[i]) != 1 for i in range(256)):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def forget(self) -> None:
        self.memory.clear()
        self.rows = Rows()

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        fast = [s.isascii() and s.isprintable() for s in segments]
        rest = iter(self.a.encode_batch([s for s, f in zip(segments, fast) if not f], add_special_tokens=False))
        return [self.ranked.encode_ordinary(s) if f else next(rest).ids for s, f in zip(segments, fast)]

    def align(self, segments: list[str]) -> None:
        """Encodes segments and adds a row for each; where the bytes differ, the row says so and is empty."""
        all_a, all_b, raws = self.encode_a(segments), self.b.encode([s[1:] for s in segments], num_threads=1), [s.encode() for s in segments]
        join = lambda table, ids: b"".join(map(table.__getitem__, ids))
        same = np.ones(len(segments), bool)
        flat_a, flat_b = list(chain.from_iterable(all_a)), list(chain.from_iterable(all_b))
        whole = b"".join(raws)
        n_a, n_b = np.array([len(x) for x in all_a], np.int64), np.array([len(x) for x in all_b], np.int64)
        a, b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        sums = [np.add.reduceat(np.append(t[x], 0), np.minimum(np.cumsum(n) - n, len(x))) * (n > 0) for t, x, n in ((self.length_a, a, n_a), (self.length_b, b, n_b))]
        sizes = np.array([len(r) for r in raws])
        if join(self.bytes_a, flat_a) != whole or join(self.bytes_b, flat_b) != whole or (sums[0] != sizes).any() or (sums[1] != sizes).any():
            same = np.array([join(self.bytes_a, x) == raw == join(self.bytes_b, y) for x, y, raw in zip(all_a, all_b, raws)], bool)
            a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
            n_a, n_b = n_a * same, n_b * same
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        i, j, closes = merge_ends(ends_a, ends_b)
        links = a[i] * self.size_b + b[j]
        owner = np.repeat(np.arange(len(segments)), n_a)[i]
        lengths = np.bincount(owner, minlength=len(segments))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), np.int64)
        last_a[i[closes]], last_b[j[closes]] = True, 1
        last_b[np.cumsum(n_b)[n_b > 0] - 1] = 2
        # in the text, a token comes after its group's tokens of A, and after all of the groups before
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b > 0) - (last_b > 0)
        upto_a, upto_b = np.concatenate([[0], i[closes] + 1]), np.concatenate([[0], j[closes] + 1])
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + upto_b[group_a]] = list(map(self.text_a.__getitem__, (2 * a + last_a).tolist()))
        parts[np.arange(len(b)) + upto_a[group_b + 1]] = list(map(self.text_b.__getitem__, (3 * b + last_b).tolist()))
        parts, cut = parts.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = np.bincount(owner[closes], minlength=len(segments))
        self.rows.add(np.column_stack([n_a, n_b, groups, same]), ["".join(parts[x:y]) for x, y in zip(cut[:-1], cut[1:])], lengths, links)

    def learn(self, segments: list[str]) -> None:
        """Rows of segments that are not known; ``memory`` says where each is until it is dropped."""
        if self.rows.n > REMEMBERED or self.rows.start[self.rows.n] > 16 * REMEMBERED:
            self.forget()
        memory = self.memory
        fresh = [s for s in dict.fromkeys(segments) if s not in memory]
        for at in range(0, len(fresh), 8192):
            part = fresh[at : at + 8192]
            memory.update(zip(part, range(self.rows.n, self.rows.n + len(part))))
            self.align(part)

    def documents(self, texts: list[str | None]) -> pd.DataFrame:
        """Digest columns, distinct pairs and their occurrences of each text."""
        cut = [self.segments(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self.learn(flat)
        n = np.array([len(c) for c in cut], np.int64)
        row = np.array(list(map(self.memory.__getitem__, flat)), np.int64)
        doc = np.repeat(np.arange(len(texts)), n)
        # a text with a segment that differs does so itself, unless differences make up for each other
        for k in np.unique(doc[self.rows.sizes[row, 3] == 0]).tolist():
            self.align([" " + texts[k]])
            row[doc == k] = self.rows.n - 1
            if n[k] > 1:
                keep = (doc != k) | (np.arange(len(doc)) == np.flatnonzero(doc == k)[0])
                row, doc = row[keep], doc[keep]
        for s in {s for s in flat if len(s) > SHORT}:
            del self.memory[s]
        rows, size = self.rows, len(texts)
        n_a, n_b, n_groups = (np.bincount(doc, rows.sizes[row, c], size).astype(np.int64) for c in range(3))
        edge, of = np.searchsorted(doc, np.arange(size + 1)).tolist(), row.tolist()
        said = [self.between.join(map(rows.said.__getitem__, of[x:y])) for x, y in zip(edge[:-1], edge[1:])]
        # a segment's pairs once a document, with how often it has the segment
        seg, times = np.unique(doc * rows.n + row, return_counts=True)
        of_doc, of_row = seg // rows.n, seg % rows.n
        start = rows.start[of_row]
        length = rows.start[of_row + 1] - start
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        key, weight = np.repeat(of_doc, length) * (self.size_a * self.size_b) + rows.pairs[at], np.repeat(times, length)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        often = np.add.reduceat(weight[order], new) if len(new) else np.zeros(0, np.int64)
        pairs, owner = key[new] % (self.size_a * self.size_b), key[new] // (self.size_a * self.size_b)
        cuts = np.searchsorted(owner, np.arange(size + 1))
        n_links = np.diff(np.concatenate([[0], np.cumsum(often)])[cuts])
        digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
        lists = lambda values: [values[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest, "pairs": lists(pairs), "occurrences": lists(often)})


#: The aligner of this worker, by its files; other work drops it.
_aligners: dict[tuple[str, ...], Aligner] = HELD.setdefault("token_alignment", {})


def aligned_documents(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", sides: str = ";", between: str = "|") -> DataFrame:
    """One row a document: a number of its own, its digest columns, and its distinct id pairs with their occurrences; saved."""
    prepare(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("token_alignment")
        key = (byte_level, pieces, sides, between)
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        aligner = _aligners[key]
        try:
            for frame in frames:
                out = aligner.documents([t if isinstance(t, str) else None for t in frame["text"]])
                out.insert(0, "doc_id", frame["doc_id"].array)
                yield out
        finally:
            aligner.forget()
            release("token_alignment")

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, occurrences array<long>"
    # ids go as text, since pandas would make numbers with nulls doubles
    found = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)
    return saved(found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, count (documents that hold it) and best (whether it is the highest count of its A id, ties included)."""
    counts = saved(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    counts = counts.withColumn("a", F.floor(F.col("pair") / size_b))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str, **names) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; ``names`` are the columns and separators of ``aligned_documents``."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    aligned = aligned_documents(docs, byte_level, pieces, **names)
    counts, n = kept(pair_counts(aligned, size_b))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "occurrences")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.occurrences").alias("k"))
    met = links.join(sized(counts, n, 24), "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("count")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "occurrences").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
