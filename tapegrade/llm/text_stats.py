"""Statistics of documents, vectorised over the bytes of an Arrow batch of texts."""

from __future__ import annotations

import numpy as np

from .common import LOWER, SPACE, U64, mix, span_hashes, word_spans

#: Frequent words of the corpus' languages (fixed values).
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "ein", "mit", "de", "la", "le", "et", "les", "el", "que", "y", "en", "los")

NAMES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bar", "exclamation", "period", "comma", "other_punctuation",
    "non_ascii", "space", "words_per_line", "log_lines", "repeated_lines", "distinct_words", "repeated_pairs", "repeated_triples",
    "stop_words", "capital_words", "long_words", "word_length_spread", "most_frequent_word",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


CLASSES = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _table("0123456789"), "symbol": _table("#*$%&<>@^~_=+{}[]\\"), "bar": _table("|"), "exclamation": _table("!"),
    "period": _table("."), "comma": _table(","), "other_punctuation": _table("?:;\"'()/-"), "non_ascii": np.arange(256) >= 128, "space": SPACE,
}


def repeated_share(doc: np.ndarray, values: np.ndarray, n_docs: int, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the share of values that equal an earlier one, and the share of the most frequent one."""
    repeats, most = np.zeros(n_docs), np.zeros(n_docs)
    if len(values):
        order = np.lexsort((values, doc))
        d, v = doc[order], values[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
        repeats = np.bincount(d[~new], minlength=n_docs).astype(float)
        at = np.flatnonzero(new)
        np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    n = np.maximum(count, 1)
    return repeats / n, most / n


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document; all zero for an empty text."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    out = {k: np.zeros(n_docs) for k in NAMES}
    total = np.maximum(size, 1)

    def sums(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[offsets[1:]] - run[offsets[:-1]]

    out["log_bytes"] = np.log1p(size)
    for k, table in CLASSES.items():
        out[k] = sums(table[data]) / total
    starts, ends, doc = word_spans(data, offsets)
    n_words = np.bincount(doc, minlength=n_docs)
    words = np.maximum(n_words, 1)
    length = ends - starts
    out["log_words"] = np.log1p(n_words)
    out["mean_word"] = np.bincount(doc, length, n_docs) / words
    out["long_words"] = np.bincount(doc, length > 20, n_docs) / words
    out["word_length_spread"] = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, n_docs) / words - out["mean_word"] ** 2, 0))
    if len(starts):
        out["capital_words"] = np.bincount(doc, CLASSES["upper"][data[starts]], n_docs) / words
    low = LOWER[data]
    hashes = span_hashes(low, starts, ends)
    stops = np.sort(stop_hashes())
    if len(hashes):
        at = np.minimum(np.searchsorted(stops, hashes), len(stops) - 1)
        out["stop_words"] = np.bincount(doc, stops[at] == hashes, n_docs) / words
    repeats, out["most_frequent_word"] = repeated_share(doc, hashes, n_docs, n_words)
    out["distinct_words"] = np.where(n_words > 0, 1 - repeats, 0)
    with np.errstate(over="ignore"):
        for k, name in ((2, "repeated_pairs"), (3, "repeated_triples")):
            if len(hashes) >= k:
                inside = doc[k - 1 :] == doc[: len(doc) - k + 1]
                joint = np.zeros(len(hashes) - k + 1, U64)
                for j in range(k):
                    joint = mix(joint * U64(31) + hashes[j : len(hashes) - k + 1 + j])
                out[name], _ = repeated_share(doc[: len(joint)][inside], joint[inside], n_docs, np.maximum(n_words - k + 1, 0))
    lines, line_ends, line_doc = word_spans(data, offsets, data != 10)
    n_lines = np.bincount(line_doc, minlength=n_docs)
    out["log_lines"] = np.log1p(n_lines)
    out["words_per_line"] = np.log1p(n_words / np.maximum(n_lines, 1))
    out["repeated_lines"], _ = repeated_share(line_doc, span_hashes(data, lines, line_ends), n_docs, n_lines)
    return np.column_stack([out[k] for k in NAMES])


def stop_hashes() -> np.ndarray:
    raw = " ".join(STOP_WORDS).encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return span_hashes(data, starts, ends)
