"""Two-stage suffix sorting in numpy, and the classes of equal prefixes that it gives.

Of two neighbouring suffixes one is the smaller. Stage one sorts directly only the suffixes that are
smaller than their successor (type B). Stage two scans the buckets of first bytes in ascending order and
induces the others (type A): when suffix q is met, its predecessor q-1, if of type A, goes to the next free
place at the front of its own bucket. A bucket is scanned as whole arrays: first what smaller buckets
have put there, then, in waves, the predecessors with the bucket's own byte, then its type B suffixes.

Sorting stops at ``depth`` bytes, which is all that prefixes of that length need.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as numbers in the order of the bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text),), ">u8", padded, strides=(1,))


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is larger than its successor; the end of the text is smaller than any byte."""
    n = len(text)
    if n == 0:
        return np.zeros(0, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    falls = text[change] > text[change + 1]
    # a run of one byte shares the type of its last position
    return np.repeat(np.append(falls, True), np.diff(np.concatenate([[-1], change, [n - 1]])))


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a[i] and b[i], up to ``depth``."""
    words = _words(np.concatenate([text, np.zeros(depth + 8, np.uint8)]))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, depth, 8):
        x = words[a[live] + k].astype(np.uint64) ^ words[b[live] + k].astype(np.uint64)
        same = x == 0
        differ = x[~same].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        out[live[~same]] = k + differ.argmax(1)
        live = live[same]
        out[live] = k + 8
    return np.minimum(out, depth)


def sort_direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their suffixes' first ``depth`` bytes, eight bytes a round."""
    if len(at) < 2:
        return at
    words = _words(np.concatenate([text, np.zeros(depth + 8, np.uint8)]))
    key = words[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for k in range(8, depth, 8):
        group = np.cumsum(new) - 1
        # groups whose members are all equal over the whole depth need no further round
        pairs = np.flatnonzero(~new)
        unequal = np.zeros(group[-1] + 1, bool)
        if len(pairs):
            unequal[group[pairs[_differ(words, at[pairs], at[pairs - 1], k, depth)]]] = True
        live = np.flatnonzero(unequal[group])
        if not len(live):
            break
        key = words[at[live] + k].astype(np.uint64)
        if k + 8 > depth:
            key &= np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (k + 8 - depth))) & 0xFFFFFFFFFFFFFFFF)
        own = group[live]
        order = np.lexsort((key, own))
        at[live] = at[live][order]
        key = key[order]
        new[live] |= np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    return at


def _differ(words: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, depth: int) -> np.ndarray:
    """Whether suffixes differ between bytes ``start`` and ``depth``."""
    out = np.zeros(len(a), bool)
    for k in range(start, depth, 8):
        x = words[a + k].astype(np.uint64) ^ words[b + k].astype(np.uint64)
        if k + 8 > depth:
            x >>= np.uint64(8 * (k + 8 - depth))
        out |= x != 0
    return out


def suffix_array(text: np.ndarray, wanted: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
    """Positions (all, or the ``wanted`` ones) in the order of their suffixes, to ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    depth = n if depth is None else depth
    larger = types(text)
    member = np.ones(n, bool)
    if wanted is not None:
        member[:] = False
        member[wanted] = True
        # an induced suffix needs its successor: follow type A to the next type B
        step = wanted[larger[wanted]] + 1
        while len(step):
            step = step[step < n]
            step = step[~member[step]]
            member[step] = True
            step = step[larger[step]] + 1
    positions = np.flatnonzero(member)
    direct = sort_direct(text, positions[~larger[positions]], depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    induced = member & larger
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    if induced[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))  # its successor, the end, comes before all
    for c in range(256):
        front = []
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(wave):
            front.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == c)]
        bucket = np.concatenate([*front, direct[edges[c] : edges[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        first = text[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(out)
    if wanted is not None:
        keep = np.zeros(n, bool)
        keep[wanted] = True
        order = order[keep[order]]
    return order


def prefix_classes(text: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted positions in suffix order, and where classes of equal prefixes of ``depth`` bytes start."""
    order = suffix_array(text, wanted, depth)
    if not len(order):
        return order, np.zeros(0, np.int64)
    lcp = common_prefixes(text, order[1:], order[:-1], depth)
    return order, np.concatenate([[0], np.flatnonzero(lcp < depth) + 1])
