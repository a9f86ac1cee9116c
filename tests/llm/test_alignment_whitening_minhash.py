"""Token alignment, whitening and MinHash against brute force on whole documents, numpy's full eigenproblem, and all pairs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tapegrade.llm import minhash, ngram_jaccard, queries, token_alignment, whitening
from tapegrade.llm.common import buffers

WORD = re.compile("[^\x20\x09-\x0d]+")


def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path()


def aligned_whole(rows):
    """The contract, document by document, on encodings of the whole texts by both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level, pieces = paths()
    a = Tokenizer.from_file(byte_level)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces)
    to_byte = token_alignment.byte_of_character()
    found, holds = [], Counter()
    for doc_id, text in rows:
        links, said, n_a, n_b, groups = [], "", 0, 0, 0
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in x]
            parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
                n_a, n_b = len(x), len(y)
                ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
                starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
                first = 0
                for i in range(n_a):
                    while ends_b[first] <= starts_a[i]:
                        first += 1
                    j = first
                    while j < n_b and starts_b[j] < ends_a[i]:
                        links.append((x[i], y[j]))
                        j += 1
                common, groups = sorted(set(ends_a) & set(ends_b)), len(set(ends_a) & set(ends_b))
                parts, low = [], 0
                for end in common:
                    side = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if low < e <= end)  # noqa: B023, E731
                    parts.append(side(x, ends_a) + ";" + side(y, ends_b))
                    low = end
                said = hashlib.sha256("|".join(parts).encode()).hexdigest()
        holds.update(set(links))
        found.append((doc_id, n_a, n_b, groups, links, said))
    best = {}
    for (i, _), k in holds.items():
        best[i] = max(best.get(i, 0), k)
    return [(d, n_a, n_b, g, len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), said) for d, n_a, n_b, g, links, said in found]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  spaces  ", "tab\tand\nline\n\n  indent\r\n", "▁mark ▁ mark", "no break   em", "<|endoftext|> <s> </s> <unk> <0x41>", "é中文\U0001f600 é ﻿", "nul\x00byte",
    "it's they'll 'S 123456 3.14", "\x1c\x1d a \x85 b", "x" * 3000, "word " * 500, "中文" * 400, "a\n b\n  c", " \n ", "café   line", "\U0001f468‍\U0001f469‍\U0001f467 family",
]


def test_alignment_equals_whole_encodings(spark, sf):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "the same words"), (None, "the same words"), (3, "the same words")]
    rows += [(1000 + r.doc_id, r.text) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row int, pairs string, best int").repartition(3)
    got = Counter(tuple(r) for r in token_alignment.align(df, *paths()).collect())
    assert got == Counter(aligned_whole(rows))
    assert sum(r[4] for r in got) > 10000
    empty = token_alignment.align(df.limit(0), *paths())
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_digests_groups_as_the_contract_writes_them(spark, tmp_path):
    """``a1,a2|b1;a3|b2,b3``, groups parted by semicolons and their sides by bars."""
    text = "the tokenizers disagree, unbelievably 3.14 中文"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, to_byte = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1]), token_alignment.byte_of_character()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ends_a = np.cumsum([len(a.id_to_token(i)) for i in x]).tolist()
    ends_b = np.cumsum([1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in y]).tolist()
    assert set("".join(a.id_to_token(i) for i in x)) <= set(to_byte) and ends_a[-1] == ends_b[-1] == len(text.encode()) + 1
    cuts = [0, *sorted(set(ends_a) & set(ends_b))]
    ids = lambda of, ends, low, high: ",".join(str(i) for i, e in zip(of, ends) if low < e <= high)
    said = ";".join(ids(x, ends_a, low, high) + "|" + ids(y, ends_b, low, high) for low, high in zip(cuts, cuts[1:]))
    got = {r.doc_id: r.groups_sha256 for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(said.encode()).hexdigest(), 2: ""}


def test_a_full_memory_and_long_texts_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefg ", k=rng.randint(1, 12))) for _ in range(40)) for _ in range(30)] + ["long " * 40_000 + "z" * 200, "▁ " + "y" * 100, "\n" * 80]
    want = token_alignment.Aligner(*paths()).documents(texts)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    small = token_alignment.Aligner(*paths())
    got = [small.documents([t]) for t in texts]
    for k, x in enumerate(got):
        for c in want.columns:
            assert np.array_equal(x[c][0], want[c][k])


def test_ranks_encode_as_the_library_does(spark, sf):
    aligner = token_alignment.Aligner(*paths())
    rng = random.Random(2)
    texts = [" " + r.text for r in queries.documents(spark, sf).limit(40).collect() if r.text] + [" " + "".join(chr(rng.randrange(32, 127)) for _ in range(60)) for _ in range(300)]
    assert aligner.ranked is not None
    assert aligner.encode_a(texts) == [e.ids for e in aligner.a.encode_batch(texts, add_special_tokens=False)]


def test_merge_ends_walks_both():
    i, j, closes = (x.tolist() for x in token_alignment.merge_ends(np.array([2, 3, 7, 9]), np.array([1, 3, 4, 5, 9])))
    assert list(zip(i, j)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (2, 4), (3, 4)]
    assert [(x + 1, y + 1) for x, y, c in zip(i, j, closes) if c] == [(2, 2), (4, 5)]


def whitened(x, k):
    n = len(x)
    c = x - np.array([sum(col) / n for col in x.T.tolist()])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def table(df):
    rows = df.collect()
    k = max(r.component for r in rows)
    by = {(r.vec_id, r.component): r for r in rows}
    ids = sorted({r.vec_id for r in rows})
    return rows, np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids]), by, ids


@pytest.mark.parametrize("decay, expands", [(1.0, True), (0.5, False)])
def test_whitening_equals_the_full_eigenproblem(spark, decay, expands):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 60)) @ np.linalg.qr(rng.standard_normal((60, 60)))[0] * decay ** np.arange(60) * 100
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    fit = whitening.Whitening(df, components=8)
    assert (fit.passes > 5) == expands
    rows, w, by, ids = table(fit.transform())
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    want, share = whitened(whole, 8)
    assert len(rows) == 2400 and np.abs(np.abs(w) - np.abs(want)).max() < 1e-7
    assert (np.sign(w) * np.sign(want))[:, 0].std() < 1  # one sign a component
    sums = whole.sum(0)
    for i in (0, 7, 299):
        r = by[i, 3]
        assert r.n == 300 and r.deviation == sum((300 * int(v) - int(s)) ** 2 for v, s in zip(whole[i], sums)) and abs(r.explained / share[2] - 1) < 1e-9
    assert 0 <= rows[0].identity_error < 1e-9 and len({r.identity_error for r in rows}) == 1


def test_whitening_of_odd_vectors(spark):
    x = [[1.0, 2.0, 3.0], [2.0, 1.0, 3.0], [4.0, 4.0, 3.0], [0.5, 2.5, 3.0], [0.5, 2.5, 3.0]]
    odd = [(9, None), (9, []), (9, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (9, [None, 1.0, 1.0]), (9, [1e300, 0.0, 0.0]), (9, [1.0, 2.0]), (9, [1.0] * 4)]
    rows = [(i if i < 4 else None, v) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, component int, w double")
    got = whitening.whiten(df).collect()
    assert len(got) == 15 and Counter(r.vec_id for r in got) == Counter({0: 3, 1: 3, 2: 3, 3: 3, None: 3})
    # the constant dimension leaves a component without variance
    assert all((r.whitened is None) == (r.component == 3) and r.n == 5 for r in got) and got[0].identity_error < 1e-9
    one = whitening.whiten(df.filter("vec_id = 0")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)]
    assert whitening.whiten(df.filter("vec_id = 9 AND embedding IS NULL")).count() == 0 and whitening.whiten(df.limit(0)).columns[:2] == ["vec_id", "component"]
    large = spark.createDataFrame([(i, [float(v) * 2**50, 1.0]) for i, v in enumerate((1, -3, 2, 30))], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect()} == {None}
    few = whitening.whiten(large.filter("vec_id < 3").withColumn("embedding", whitening.F.expr("transform(embedding, v -> v / 33554432)"))).collect()
    xs = np.array([[int(v) * 2**25 * 64 + 1_000_000, 0] for v in (1, -3, 2)], object)
    want = {i: int(sum((3 * v - s) ** 2 for v, s in zip(r, xs.sum(0)))) for i, r in enumerate(xs.tolist())}
    assert {r.vec_id: r.deviation for r in few} == {i: v if v < 2**63 else None for i, v in want.items()}


def test_whitening_of_the_table(spark, sf):
    df = queries.embeddings(spark, sf)
    x = np.floor(64 * np.array([r.embedding for r in df.orderBy("vec_id").collect()])).astype(np.int64) + 1_000_000
    _, w, _, _ = table(queries.op12_whitening(spark, sf))
    want, _ = whitened(x, 32)
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-8


def shingle_set(text, width):
    words = [w for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def components(rows, width, percent):
    """doc number -> (size, smallest id reachable) by all pairs."""
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and percent * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(top(k), []).append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return [(d, len(sets[k]), smallest[top(k)] if sets[k] else d) for k, (d, _) in enumerate(rows)]


def near_copies(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "A b", "a B", "a b c", "a b c d", "a b c d e", "x"])]
    base = [rng.choices(words, k=rng.choice((6, 12, 30, 80, 200))) for _ in range(12)]
    common = rng.choices(words, k=60)
    while len(rows) < n:
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = rng.choices(words, k=rng.choice((5, 20, 60))) + common
        rows.append((len(rows), " ".join(text)))
    return rows + [(None, rows[20][1]), (None, "only here once and never again"), (30, rows[40][1]), (30, rows[30][1])]


@pytest.mark.parametrize("seed, width, percent", [(1, 4, 80), (2, 5, 80), (3, 2, 85)])
def test_minhash_finds_the_components_of_all_pairs(spark, seed, width, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, node int, hub int, kept string").repartition(3)
    got = Counter(tuple(r) for r in minhash.near_duplicates(df, percent, width).collect())
    want = components(rows, width, percent)
    assert got == Counter((d, n, c, d == c) for d, n, c in want)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert minhash.near_duplicates(df.limit(0), percent, width).count() == 0


def test_small_blocks_change_nothing(spark):
    rows = near_copies(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = Counter((d, n, c, d == c) for d, n, c in components(rows, 4, 80))
    assert Counter(tuple(r) for r in minhash.near_duplicates(df, 80, 4, block=8).collect()) == want


def test_minhash_over_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_minhash(spark, sf).collect()) == Counter((d, n, c, d == c) for d, n, c in components(rows, 4, 80))


def sets_of(texts, width=3):
    import pyarrow as pa

    return ngram_jaccard.shingles(*buffers(pa.array(texts)), width)


def test_sketches_agree_with_the_similarity():
    rng = np.random.default_rng(5)
    for n, m, common in ((9, 9, 8), (100, 90, 80), (2000, 1800, 1600)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:common], rng.integers(0, 2**63, m - common).astype(np.uint64)])
        doc = np.repeat([0, 1], [n, m])
        tables = [minhash.one_permutation(doc, np.concatenate([a, b]), 2, k) for k in range(200)]
        share = np.mean([(t[0] == t[1]).mean() for t in tables])
        assert abs(share - common / (n + m - common)) < 0.02 and not any((t == minhash.EMPTY).any() for t in tables)


def test_sketches_do_not_depend_on_their_batch():
    texts = ["", "one", "a b c d", "the cat sat on the mat " * 9, "a b c d"]
    whole = minhash.band_keys(*sets_of(texts), len(texts))
    assert whole.shape == (5, 64) and (whole[2] == whole[4]).all() and not (whole[2] == whole[3]).any()
    for k, t in enumerate(texts):
        assert (minhash.band_keys(*sets_of([t]), 1)[0] == whole[k]).all()


def test_a_bucket_has_a_star_of_edges(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(60)]
    join = minhash.MinHash(spark.createDataFrame(rows, "doc_id long, text string"), 80, 4)
    edges = join.stars().collect()
    # nearly all share their keys: about as many edges as documents, far from 60 * 59 / 2
    assert len({e.node for e in edges}) == 60 and len(edges) < 400
