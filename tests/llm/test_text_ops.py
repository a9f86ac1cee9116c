"""Byte and word operators against brute force on small tables with the awkward cases."""

import hashlib
import random
import re
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapegrade.llm import license_scan, ngram_jaccard, quality_rules, suffix_dedup
from tapegrade.llm.suffix_array import prefix_classes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Rows (doc_id, text); the other columns are empty or clash with names that operators return."""
    return spark.createDataFrame([(i, t, None, "s", 0, 0.5, "h") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (6, "a b c"), (None, base[0]), (7, "x" * 400), (8, "x" * 300), (9, "ab" * 200)]
    for i in range(10, 10 + n):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.6:
            t = rng.choice(base)[:80] + " " + " ".join(rng.choice(words) for _ in range(50)) + t[-90:]
        rows.append((i, t))
    rows.append((10, rows[-1][1]))  # an id twice
    rows.append(rows[-2])  # a row twice
    rng.shuffle(rows)
    return rows


def test_suffix_array_is_sorted():
    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        b = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdefgh") for _ in range(rng.randint(1, 90))) * rng.choice([1, 3])
        t = np.frombuffer(b, np.uint8)
        assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_prefix_classes_match_equal_strings():
    import numpy as np

    rng = random.Random(2)
    for _ in range(60):
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 80))) * 2
        d = rng.randint(1, 8)
        wanted = np.array(sorted(rng.sample(range(len(b) - d + 1), min(20, len(b) - d))))
        order, starts = prefix_classes(np.frombuffer(b, np.uint8), wanted, d)
        groups = {tuple(sorted(g.tolist())) for g in np.split(order, starts[1:])}
        by = {}
        for i in wanted.tolist():
            by.setdefault(b[i : i + d], []).append(i)
        assert groups == {tuple(v) for v in by.values()}


def removed(rows, width=50):
    """Brute force: smallest id that starts each string; a null id ranks last."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            first[s] = min(first.get(s, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < key(i):
                gone[k : k + width] = [True] * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def none_last(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_suffix_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rows = corpus()
    got = suffix_dedup.suffix_dedup(table(spark, rows), keep=("source",), chunk_bytes=4000, least_bytes=500)
    got = got.select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert none_last([tuple(r) for r in got]) == none_last(removed(rows))


def test_suffix_dedup_decodes_and_keeps_columns(spark):
    text = "é" * 60
    got = suffix_dedup.suffix_dedup(table(spark, [(1, "a" + text), (2, text + "b")]), keep=("source", "host"), decode=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == ["a" + text, "b"]
    assert [(r["source"], r["host"]) for r in got] == [("s", "h")] * 2


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)])


def components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), i if not sets[k] else least.get(root(k))) for k, (i, _) in enumerate(rows)]


def near_corpus(seed=3, bases=6, copies=70):
    rng = random.Random(seed)
    rows, n = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, " \t")], 5
    for b in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 90))]
        for _ in range(copies if b == 0 else rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(3000)}"
            rows.append((n, " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_components_match_brute_force(spark, block):
    rows = near_corpus()
    got = ngram_jaccard.Join(table(spark, rows), block=block).components().collect()
    assert none_last([tuple(r) for r in got]) == none_last(components(rows))


def borderline_corpus(seed=11, bases=3, copies=60):
    """Copies whose similarities lie close about the threshold, so that bounds alone decide little."""
    rng = random.Random(seed)
    rows, n = [], 0
    for b in range(bases):
        words = [f"w{b}x{k}" for k in range(120 + 40 * b)]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("shape", [{}, {"block": 7}, {"block": 16, "part": 3}])
def test_jaccard_near_the_threshold(spark, shape):
    rows = borderline_corpus()
    got = ngram_jaccard.Join(table(spark, rows), **shape).components().collect()
    assert none_last([tuple(r) for r in got]) == none_last(components(rows))


def test_pairs_that_verification_refuses_are_searched_again(spark, monkeypatch):
    # bits that bound nothing: every pair of one hub and of like sizes is a candidate
    monkeypatch.setattr(ngram_jaccard, "parity_bits", lambda doc, s, n: pa.array([bytes(8)] * len(n), pa.binary()))
    rows = borderline_corpus(5, 2, 14)
    got = ngram_jaccard.Join(table(spark, rows), block=5).components().collect()
    assert none_last([tuple(r) for r in got]) == none_last(components(rows))


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m, common in ((5, 6, 4), (100, 90, 85), (33, 31, 30), (700, 640, 630)):
        pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64) * np.uint64(2)
        sets = [np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])]
        doc = np.repeat([0, 1], [n, m])
        bits = ngram_jaccard.parity_bits(doc, np.concatenate(sets), np.array([n, m])).to_pylist()
        for s, raw in zip(sets, bits):
            power = len(raw).bit_length() + 2
            want = np.bincount((s >> np.uint64(64 - power)).astype(int), minlength=1 << power) % 2
            assert (np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little") == want).all()
        x, y = (np.frombuffer(r, np.uint64)[None, :] for r in bits)
        while x.shape[1] > y.shape[1]:
            x = ngram_jaccard.folded(x)
        apart = int(np.bitwise_count(x ^ y).sum())
        true = n + m - 2 * common
        assert apart <= true and (true - apart) % 2 == 0


def test_entries_fit_as_by_all_pairs():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 60, 400)
    pos = (rng.random(400) * ngram_jaccard.prefix_length(n, 85)).astype(int)
    key = np.sort(rng.integers(0, 90, 400))
    most = np.minimum((n - pos)[:, None], (n - pos)[None, :])
    fits = ngram_jaccard.linked(most, n[:, None], n[None, :], 85) & (key[:, None] == key[None, :])
    np.fill_diagonal(fits, False)
    assert (ngram_jaccard.fitting(n, pos, key, 85) == fits.any(1)).all()


def test_jaccard_judges_rows_by_their_texts(spark):
    """Ids that repeat or are null, null and very long texts, and extra columns with the operator's own names."""
    words = [f"x{k}" for k in range(60)]
    near = lambda k: " ".join(words[:-k] + ["y"])
    long = [f"long{k}" for k in range(250_000)]
    rows = [(2, near(1)), (2, "of its own a b c d"), (7, near(2)), (None, near(3)), (9, near(4)), (None, "z y x w v"), (5, None), (6, ""), (30, " ".join(long)), (31, " ".join(long[:-9]))]
    df = table(spark, rows).selectExpr("*", "doc_id AS n", "text AS sig", "'x' AS hub", "1 AS node", "2 AS bits", "3 AS comp")
    got = sorted(((r[0], r[2]) for r in ngram_jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(2, 2), (2, 2), (7, 2), (None, 2), (9, 2), (None, None), (5, 5), (6, 6), (30, 30), (31, 30)], key=str)


def test_jaccard_rows_without_id_take_the_linked_one(spark):
    text = "a b c d e f g h"
    got = ngram_jaccard.jaccard_components(table(spark, [(None, text), (3, text), (9, text), (None, "z y x w v")])).collect()
    assert none_last([tuple(r) for r in got]) == none_last([(None, 5, 3), (3, 5, 3), (9, 5, 3), (None, 2, None)])


def test_similar_pairs_lists_every_link(spark):
    rows = near_corpus(4, 3, 12)
    links, member = ngram_jaccard.similar_pairs(table(spark, rows))
    got = {(min(r), max(r)) for r in links.collect()}
    least = {}
    for i, t in sorted(rows):
        least.setdefault(shingle_set(t), i)
    want = {(min(a, b), max(a, b)) for s, a in least.items() for u, b in least.items() if a < b and s and u and 100 * len(s & u) >= 85 * len(s | u)}
    assert got == want
    assert {r["doc_id"]: r["class_id"] for r in member.collect()} == {i: least[shingle_set(t)] if shingle_set(t) else i for i, t in rows}


def test_jaccard_of_an_empty_table(spark):
    assert ngram_jaccard.jaccard_components(table(spark, [])).count() == 0


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules_match_brute_force(spark):
    rows = corpus(9) + [(100, "a b c a b c d\na b c\na b c"), (101, "# $ x"), (102, "the of and to in " * 30), (103, "é\x0bü\x1f ß")]
    got = quality_rules.quality_rules(table(spark, rows)).collect()
    want = [(i, *rules(t)) for i, t in rows]
    assert none_last([tuple(r)[:6] for r in got]) == none_last(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rules_are_one_projection(spark):
    plan = quality_rules.quality_rules(table(spark, corpus()[:3]).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Python" not in plan


def test_quality_rules_of_an_empty_table(spark):
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_license_sequences(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    rows = [(1, None), (2, ""), (3, "Words. Released under the MIT License.\nMore words."), (4, f"# {apache}\nAll rights reserved."), (5, "licensed under cc by-nc 4.0\nLicensed under the Apache License, Version 2.0."), (5, "nothing"), (6, "MIT License")]
    got = {(r["doc_id"], tuple(r["sentence_ids"]), tuple(r["licenses"]), r["license"]) for r in license_scan.license_scan(table(spark, rows)).collect()}
    assert got == {
        (1, (), (), None), (2, (), (), None), (3, ("mit-short",), ("MIT",), "MIT"), (4, ("apache-long", "apache-comply", "reserved"), ("Apache-2.0",), "Apache-2.0"),
        (5, ("cc-by-nc-short", "apache-short"), ("Apache-2.0", "CC-BY-NC-4.0"), "Apache-2.0"), (5, (), (), None), (6, ("mit-name",), (), None),
    }


def test_wrapped_notices_are_recognised(spark):
    known, wrapped = license_scan.SENTENCES, lambda t, mark="": textwrap.fill(t, 70, initial_indent=mark, subsequent_indent=mark)
    mit = "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + wrapped(known["mit-grant"]) + "\n\n" + wrapped(known["mit-notice"] + ".")
    apache = wrapped(known["apache-long"] + "; " + known["apache-comply"] + ". You may obtain a copy of the License at", "# ") + "\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n" + wrapped(known["apache-asis"] + ".", "# ")
    bsd = wrapped(known["bsd-redistribute"]) + "\n\n" + wrapped("1. " + known["bsd-source"] + ".") + "\r\n" + wrapped("2. " + known["bsd-binary"] + ".")
    gpl = wrapped(known["gpl-free"] + ".", " * ") + "\n *\n" + wrapped(known["gpl-hope"] + "; without even the implied warranty of FITNESS.", " * ")
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
    rows = [(1, mit), (2, apache), (3, bsd), (4, gpl), (5, mpl), (6, "Version\n2.0\nis out. 2.0"), (7, "MIT License\n" + wrapped(known["mit-grant"])), (8, "Released under\n\nthe MIT License"), (9, "This Source Code Form is subject to the terms of the Mozilla Public License, v.")]
    got = {r["doc_id"]: (tuple(r["sentence_ids"]), tuple(r["licenses"])) for r in license_scan.license_scan(table(spark, rows)).collect()}
    assert got == {
        1: (("mit-name", "mit-grant", "mit-notice"), ("MIT",)), 2: (("apache-long", "apache-comply", "apache-obtain", "apache-asis"), ("Apache-2.0",)),
        3: (("bsd-redistribute", "bsd-source", "bsd-binary"), ("BSD-3-Clause",)), 4: (("gpl-free", "gpl-hope"), ("GPL-3.0-or-later",)), 5: (("mpl-short",), ("MPL-2.0",)),
        6: ((), ()), 7: (("mit-name", "mit-grant"), ("MIT",)), 8: ((), ()), 9: ((), ()),
    }


def test_license_scan_of_an_empty_table(spark):
    assert license_scan.license_scan(table(spark, [])).count() == 0


def license_texts():
    known, fill = license_scan.SENTENCES, lambda t, mark="": textwrap.fill(t, 60, initial_indent=mark, subsequent_indent=mark)
    clauses = [fill(f"{k}. {known[n]}.") for k, n in enumerate(("bsd-source", "bsd-binary", "bsd-holder"), 1)]
    bsd = lambda n: "\n\n".join([fill(known["bsd-redistribute"]), *clauses[:n]])
    advertised = "\n\n".join([fill(known["bsd-redistribute"]), clauses[0], clauses[1], fill("3. " + known["bsd-advertising"] + " This product includes software."), clauses[2].replace("3.", "4.")])
    gpl = lambda n: fill(known[n] + ".", " * ")
    return {
        "two": (bsd(2), ["BSD-2-Clause"]), "three": (bsd(3), ["BSD-3-Clause"]), "three twice": (bsd(3) + "\n" + bsd(3), ["BSD-3-Clause"]), "four": (advertised, ["BSD-4-Clause"]),
        "isc": (fill(known["isc-grant"] + "."), ["ISC"]), "0bsd": (fill(known["0bsd-grant"] + "."), ["0BSD"]), "mit-0": (fill(known["mit0-grant"] + "."), ["MIT-0"]), "mit": (fill(known["mit-grant"]) + "\n" + fill(known["mit-notice"] + "."), ["MIT"]),
        "lgpl": (gpl("lgpl21-later"), ["LGPL-2.1-or-later"]), "lgpl3": (gpl("lgpl3-later"), ["LGPL-3.0-or-later"]), "agpl": (gpl("agpl3-later") + "\n *\n" + gpl("gpl-hope"), ["AGPL-3.0-or-later"]), "gpl2": (gpl("gpl2-later"), ["GPL-2.0-or-later"]), "gpl3": (gpl("gpl3-later"), ["GPL-3.0-or-later"]), "only": (gpl("gpl2-only"), ["GPL-2.0-only"]),
        "epl": (fill(known["epl2-terms"]), ["EPL-2.0"]), "zlib": (fill(known["zlib-asis"] + ". " + known["zlib-grant"]), ["Zlib"]), "unlicense": (known["unlicense"] + ".", ["Unlicense"]), "boost": ("Distributed under the Boost Software License, Version 1.0. (See x)", ["BSL-1.0"]),
        "spdx": ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), "spdx or": ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", []), "two spdx": ("SPDX-License-Identifier: Zlib\nSPDX-License-Identifier: 0BSD", ["0BSD", "Zlib"]),
        "within": ("We wrote: this is released under the MIT License today.", []), "odd space": ("A.\x0bReleased under the ISC License.\x0bx\u2028y\x01", ["ISC"]), "none": (None, []), "empty": ("", []), "long": ("word and line.\n" * 20_000 + "Released under the\nISC License", ["ISC"]), "shown": ("\n\n".join(["MIT License"] * 3), []),
    }


def test_license_texts_of_many_kinds_and_their_sql(spark):
    """Two, three and four clauses apart, declarations, wrapped notices; the SQL finds the same on all of them."""
    texts = license_texts()
    rows = [(k, t) for k, (t, _) in enumerate(texts.values())]
    found = license_scan.license_scan(table(spark, rows)).collect()
    assert {name: r["licenses"] for name, r in zip(texts, sorted(found, key=lambda r: r["doc_id"]))} == {name: want for name, (_, want) in texts.items()}
    con = duckdb.connect()
    con.register("given", pa.table({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]}))
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    want = {(r["doc_id"], len(r["sentence_ids"]), " ".join(r["sentence_ids"]), " ".join(r["licenses"]), r["license"]) for r in found}
    assert set(con.execute(license_scan.oracle()).fetchall()) == want


def test_every_license_has_a_sentence_and_a_rule():
    assert len(license_scan.NAMES) >= 40 and {name for name, _ in license_scan.RULES} >= set(license_scan.NAMES)
    assert {i for _, ids in license_scan.RULES for i in ids} <= set(license_scan.SENTENCES)
