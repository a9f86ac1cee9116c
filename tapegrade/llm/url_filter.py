"""URL filters over a sorted array of 64-bit digests that workers map into memory.

A rule is a host and a path prefix. It fits a url when the url's host is the rule's host or a
subdomain of it and the url's path starts with the rule's path; of several, the longest rule wins (on
equal length, the one with the longer host). The index is three arrays in one file: xxhash64 keys in
sorted order, offsets, and the full rule strings. The driver writes it once and ships it with
``SparkContext.addFile``; every Python worker maps it, so that its pages are shared by the workers of a
machine and the rule list may be larger than a worker's heap. Lookups probe, for every
label-aligned host suffix and every path length that occurs among the rules, the digest array by
binary search over a whole batch at once, and then confirm the stored string, so that equal digests
of different strings cannot give a wrong verdict (``np.searchsorted`` finds the first of equal keys;
the probe walks on over them).

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the default
verdict. Rows are judged one by one; extra columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepare

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, rest = text.partition("/")
    return Rule(verdict, _lower(host), slash + rest)


def _lower(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty for null or without ``://``."""
    if not url:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return _lower(host), tail[:end]


def _digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}")


class DigestIndex:
    """Sorted digests with their full strings, in one file that is mapped, not loaded."""

    @staticmethod
    def write(rules: list[Rule], path: str, digest=_digest) -> None:
        rules = sorted(dict.fromkeys(rules), key=lambda r: (digest(r.host, r.path), r.host, r.path, r.verdict))
        texts = [f"{r.host}\0{r.path}\0{r.verdict}".encode() for r in rules]
        lengths = np.array(sorted({len(r.path) for r in rules}), np.uint64)
        with open(path, "wb") as f:
            np.array([len(rules), len(lengths)], np.uint64).tofile(f)
            lengths.tofile(f)
            np.array([digest(r.host, r.path) for r in rules], np.uint64).tofile(f)
            np.cumsum([0, *map(len, texts)], dtype=np.uint64).tofile(f)
            f.write(b"".join(texts))

    def __init__(self, path: str, digest=_digest):
        raw = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in raw[:16].view(np.uint64))
        at = 16 + 8 * k
        self.lengths = [int(x) for x in raw[16:at].view(np.uint64)]
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.offsets = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        self.texts = raw[at + 16 * n + 8 :]
        self.digest = digest

    def entry(self, i: int) -> tuple[str, str, str]:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return tuple(bytes(self.texts[a:b]).decode().split("\0"))

    def best(self, parts: list[tuple[str, str]]) -> list[tuple[str, str] | None]:
        """For each (host, path) the winning (rule, verdict)."""
        probes, owner, shape = [], [], []
        for row, (host, path) in enumerate(parts):
            suffix = host
            while suffix:
                for n in self.lengths:
                    if n <= len(path):
                        probes.append(self.digest(suffix, path[:n]))
                        owner.append(row)
                        shape.append((len(suffix) + n, len(suffix)))
                suffix = suffix.partition(".")[2]
        out: list = [None] * len(parts)
        won = [(-1, -1)] * len(parts)
        if probes and len(self.keys):
            wanted = np.array(probes, np.uint64)
            at = np.searchsorted(self.keys, wanted)
            hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted))
            for p in hit:
                row, (total, width), i = owner[p], shape[p], int(at[p])
                if (total, width) <= won[row]:
                    continue
                host, path = parts[row]
                exact = (host[len(host) - width :], path[: total - width])
                while i < len(self.keys) and self.keys[i] == wanted[p]:
                    found = self.entry(i)
                    if found[:2] == exact:
                        out[row], won[row] = (found[0] + found[1], found[2]), (total, width)
                        break
                    i += 1
        return out


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    spark = prepare(pages.sparkSession)
    name = f"digests-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(), name)
    DigestIndex.write(rules, local)
    spark.sparkContext.addFile(local)

    def judge(batches):
        index = DigestIndex(SparkFiles.get(name))
        for b in batches:
            ids, urls = b.columns
            parts = [split_url(u) for u in urls.to_pylist()]
            found = index.best(parts)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())],
                names=SCHEMA.names,
            )

    return pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url")).mapInArrow(judge, SCHEMA)


#: The rules of the registered query.
RULES = [parse_rule(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "org/es/"), ("allow", "net/de/"), ("block", "example.net/de/8"))]

ORACLE = """
WITH s AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN r ON (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.k = 1 AND m.page_id IS NOT DISTINCT FROM p.page_id AND m.host = p.host AND m.path = p.path
"""
