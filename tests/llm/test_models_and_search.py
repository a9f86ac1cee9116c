"""URL filter, search, mixing, tokens and classifiers against brute force, the library, or held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapegrade.llm import bpe_pieces, mixing, multi_index, quality_model, queries, toxicity, url_filter
from tapegrade.llm.text_stats import NAMES, features


def model():
    return queries.tokenizer_path()


def judged(url, rules, default="allow"):
    host, path = url_filter.split_url(url)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best and best.text, best.verdict if best else default


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/en/", "http://a.Example.com/en/77?x#y", "http://example.com/en/6", "http://notexample.net/de/8", "http://x.example.net/de/81", "http://example.net/de/",
    "http://org/es", "http://org/es/", "http://a.org/es/x?y/z", "https://com?/en/", "https://b.com#/en/", "a://b://c.com/en/", "http://.com/en/", "http://com./en/", "http://É.com/en/ü",
]


def test_url_filter_matches_brute_force(spark):
    rows = [(i, u, "html", "host", "rule") for i, u in enumerate(URLS)] + [(None, "http://x.com/en/", None, None, None), (3, "://", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = sorted((tuple(r) for r in url_filter.url_filter(df, url_filter.RULES).collect()), key=str)
    assert got == sorted(((r[0], *judged(r[1], url_filter.RULES)) for r in rows), key=str)
    assert url_filter.url_filter(df.limit(0), url_filter.RULES).count() == 0


def test_digests_that_collide_are_told_apart_by_their_strings(tmp_path):
    path, same = str(tmp_path / "index"), lambda host, path: 42
    url_filter.DigestIndex.write(url_filter.RULES, path, digest=same)
    parts = [url_filter.split_url(u) for u in URLS]
    got = url_filter.DigestIndex(path, digest=same).best(parts)
    assert got == [(r[2], r[3]) if (r := judged(u, url_filter.RULES))[2] else None for u in URLS]


def vectors(spark, seed=1, n=400, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:140] = x[50]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    rows += [(1000, None, 1), (1050, [0.0] * d, 1), (1100, [float("nan")] + [1.0] * (d - 1), 1), (1150, [None] + [1.0] * (d - 1), 1), (1200, [1.0], 1), (1250, [], 1), (None, rows[3][1], 1), rows[7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), x


def nearest(x, q, k):
    x = x.astype(float)
    s = [((x[q] * x[i]).sum() / (np.sqrt((x[q] ** 2).sum()) * np.sqrt((x[i] ** 2).sum())), i) for i in range(len(x)) if i != q]
    return sorted(s, key=lambda t: (-round(t[0], 12), t[1]))[:k]


@pytest.mark.parametrize("piece", [2048, 16])
def test_whole_index_search_matches_brute_force(spark, piece):
    df, x = vectors(spark)
    index = multi_index.MultiIndex(df, candidates=1000, bucket_bytes=4096)
    assert index.visited == 1
    got = index.search(index.rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), piece=piece).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(by) == list(range(0, 400, 50))
    for q, found in by.items():
        want = nearest(x, q, 5)
        assert [found[i + 1][0] for i in range(5)] == [i for _, i in want]
        assert np.allclose([found[i + 1][1] for i in range(5)], [s for s, _ in want], atol=1e-12)


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(0)
    first, second = rng.random(9), rng.random(9)
    got = multi_index.traverse(first, second, np.ones(81, int), 81)
    total = [first[c // 9] + second[c % 9] for c in got]
    assert sorted(got) == list(range(81)) and total == sorted(total)


def test_recall_when_only_part_is_visited(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16)) * 3
    x = (centre[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    index = multi_index.MultiIndex(df, sample=2000)
    assert index.visited < 0.5
    got = index.search(index.rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")).collect()
    want = {(q, i) for q in range(0, 6000, 100) for _, i in nearest(x, q, 5)}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want) >= 0.9


@pytest.mark.parametrize("n", [1500, 5000])
def test_recall_without_clusters(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    index = multi_index.MultiIndex(df, sample=1000)
    assert index.visited < 0.95
    got = index.search(index.rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")).collect()
    want = {(q, i) for q in range(0, n, 50) for _, i in nearest(x, q, 5)}
    assert len(got) == len(want) and len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want) >= 0.9


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in (0, 50, 51)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in multi_index.nearest_rows(df).collect()}
    assert got == {(0, 1): 50, (0, 2): 51, (50, 1): 51, (50, 2): 0}


def test_search_without_usable_vectors(spark):
    df = spark.createDataFrame([(1, None), (50, [0.0])], "vec_id long, embedding array<float>")
    assert multi_index.nearest_rows(df).count() == 0
    assert multi_index.nearest_rows(df.limit(0)).count() == 0


def test_targets_share_the_budget_under_the_cap():
    got = mixing.targets([("b", 10), (None, 1000), ("a", 100)], budget=1.5)
    assert got["a"] == 200 and got["b"] == 20
    assert got[None] == pytest.approx(1.5 * 1110 - 220)


def test_targets_as_a_table_are_the_same(spark):
    rng = random.Random(11)
    for n, parts in ((0, 2), (1, 1), (7, 3), (300, 5)):
        names = [*{"".join(rng.choice("abé😀Z") for _ in range(rng.randint(0, 6))) for _ in range(n)}] + [None] * (n > 0)
        sizes = [(s, rng.choice([0, 1, 10, rng.randint(1, 10**6)])) for s in names]
        table = spark.createDataFrame(sizes, "source string, source_size long").repartition(parts)
        got = {r["source"]: r["target"] for r in mixing.goals(table).collect()}
        assert got == pytest.approx(mixing.targets(sizes), rel=1e-12)


def test_fit_finds_sums_beyond_the_window():
    epochs, take = mixing.fit_counts(np.array([320000, 330000, 500000]), np.array([1, 1, 1]), 650000.0)
    assert epochs == 0 and take.tolist() == [1, 1, 0]
    rng = random.Random(13)
    for _ in range(60):
        lengths, counts = np.array(sorted(rng.sample(range(20, 400), 4))), np.array([rng.randint(1, 3) for _ in range(4)])
        total = int((lengths * counts).sum())
        target = rng.randint(1, 2 * total - 1)
        epochs, take = mixing.fit_counts(lengths, counts, float(target), window=16)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        assert (take <= counts).all() and epochs == target // total
        assert (take * lengths).sum() == max(s for s in sums if s <= target - epochs * total)


def test_fit_hits_every_reachable_target():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.sort(rng.choice(np.arange(0, 60), 6, replace=False))
        counts = rng.integers(1, 4, 6)
        total = int((lengths * counts).sum())
        target = float(rng.uniform(0, 2 * total))
        epochs, take = mixing.fit_counts(lengths, counts, target)
        assert (take <= counts).all() and (take >= 0).all() and (epochs < 2 or not take.any())
        assert epochs * total + (take * lengths).sum() <= round(target)


def test_knapsack_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        lengths, counts = np.array(sorted(rng.sample(range(1, 30), 4))), np.array([rng.randint(0, 3) for _ in range(4)])
        budget = rng.randint(0, 80)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_mix_takes_what_targets_say(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["b", "a", "a", "a", None, "é"]), 0) for i in range(800)] + [(801, None, "a", 0), (None, "x y", "a", 0), (5, "x y", "b", 0), (5, "x y", "b", 0)]
    rows += [(2000 + i, "w " * 7, "a", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    a, b = (mixing.mix_sources(df.repartition(n), bucket_rows=16).collect() for n in (3, 5))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(rows)
    total, taken, target = {}, {}, {}
    for r in a:
        total[r["source"]] = total.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert target == pytest.approx(mixing.targets(list(total.items())))
    for s in total:
        assert abs(taken[s] - target[s]) <= 1
    assert mixing.mix_sources(df.limit(0)).count() == 0


def sentences(seed=2):
    rng = random.Random(seed)
    pool = ["the", " ", "  ", "▁", "\t", "\n", "é", "中", "😀", "1", "23", "<s>", "<0x41>", "ing", "tion", "\u0301", "�", "x" * 90]
    return ["", " ", "a", "   a", "▁▁a", "word " * 40, "x" * 3000, "\0a"] + ["".join(rng.choice(pool) if rng.random() < 0.7 else chr(rng.randint(1, 0x24F)) for _ in range(rng.randint(0, 30))) for _ in range(300)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp, texts = sentencepiece.SentencePieceProcessor(model_file=model()), sentences()
    own = bpe_pieces.encoder(model())
    for t in texts:
        assert own.encode(t) == sp.encode(t)
        assert own.decode(sp.encode(t)) == sp.decode(sp.encode(t))
    df = spark.createDataFrame([*enumerate(texts), (None, None), (1, "twice")], "doc_id long, text string")
    got = sorted((tuple(r) for r in bpe_pieces.round_trips(df, model()).collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := sp.encode(t or "")), digest(",".join(map(str, ids))), digest(sp.decode(ids))) for i, t in [*enumerate(texts), (None, None), (1, "twice")]]
    assert got == sorted(want, key=str)
    back = bpe_pieces.decode_documents(bpe_pieces.encode_documents(df, model()), model())
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, sp.decode(sp.encode(t or "")))) for i, t in [*enumerate(texts), (None, None), (1, "twice")])
    assert bpe_pieces.round_trips(df.limit(0), model()).count() == 0


def test_lockstep_equals_the_single_walk():
    own = bpe_pieces.encoder(model())
    rng = random.Random(8)
    cuts = list({"".join(rng.choice("abcdefghijklmnoprstuwé▁") for _ in range(rng.randint(1, 64))) for _ in range(2000)})
    cuts = [c for c in cuts if own.lockstep.chars.issuperset(c)]
    assert own.lockstep.encode(cuts) == [own.walk(c) for c in cuts]


def test_decoding_broken_byte_runs():
    import sentencepiece

    sp, own, rng = sentencepiece.SentencePieceProcessor(model_file=model()), bpe_pieces.encoder(model()), random.Random(9)
    for _ in range(300):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(3, 31999)]) for _ in range(rng.randint(1, 12))]
        assert own.decode(ids) == sp.decode(ids)


def labelled(spark, seed=3, n=1200):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [(5000, None), (5001, ""), (None, "bad words")], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.7)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["zidiot", "zfool", "Zclown!"]))
        if rng.random() < (0.6 if toxic else 0.05):
            text.append("muslims")
        if not good:
            text = [w + "$$$" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    labels += [(7, None, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(got, labels, column):
    want = {i: r[column] for i, *r in labels if r[column] is not None}
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert len(held) > 100
    return sum(r["predicted"] == want[r["doc_id"]] for r in held) / len(held)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 1203 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert accuracy(got, rows, 1) > 0.97
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in got)


def test_identity_terms_carry_no_weight_of_their_own(spark):
    docs, labels, _ = labelled(spark)
    gap = lambda m: abs(float(m.weights[np.searchsorted(m.keys, toxicity.word_keys(["muslims"]))[0]] - m.weights[np.searchsorted(m.keys, toxicity.word_keys(["people"]))[0]]))
    assert gap(toxicity.train(docs, labels)) < 0.1 * gap(toxicity.train(docs, labels, penalty=0.0))


def test_fit_on_sparse_rows_equals_newton_steps_on_dense_ones():
    rng = np.random.default_rng(12)
    keys = np.arange(1, 31).astype(np.uint64)
    x = (rng.random((300, 30)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, :3].sum(1) * 2 - 2)))).astype(float)
    got = toxicity.fit([(keys[r > 0], int(label)) for r, label in zip(x, y)], keys, terms=(), ridge=1.0)
    dense, w = np.column_stack([x, np.ones(300)]), np.zeros(31)
    rare = float(y.mean() < 0.5)
    share = np.where(y == rare, np.sqrt(np.mean(y != rare) / np.mean(y == rare)), 1.0) / 300
    bound = np.append(np.full(30, 1.0 / 300), 1e-9)
    for _ in range(50):
        p = 1 / (1 + np.exp(-dense @ w))
        w -= np.linalg.solve((dense * (share * p * (1 - p))[:, None]).T @ dense + np.diag(bound), dense.T @ (share * (p - y)) + bound * w)
    assert np.allclose(got.weights, w[:-1], atol=1e-3) and got.intercept == pytest.approx(w[-1], abs=1e-3)


def test_swapped_identity_terms_leave_the_score_of_a_sentence(spark):
    docs, labels, _ = labelled(spark)
    raw = lambda t: np.frombuffer(t.encode(), np.uint8)

    def margin(m, term):
        data = raw(f"they said that {term} came to town")
        p = float(m.score(data, np.array([0, len(data)]))[0])
        return np.log(p / (1 - p))

    fair, free = toxicity.train(docs, labels), toxicity.train(docs, labels, penalty=0.0)
    grams = toxicity.distinct_terms(raw("muslims"), np.array([0, 7]))[1]
    assert np.isin(grams, free.keys).sum() > 1  # substrings of the term are features
    for other in ("people", "christians", "jews"):
        gap = [abs(margin(m, "muslims") - margin(m, other)) for m in (fair, free)]
        assert gap[0] < 0.1 * gap[1], other


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    got = quality_model.score_documents(docs, quality_model.train(docs, labels)).collect()
    assert len(got) == 1203 and all(0 <= r["score"] <= 1 for r in got)
    assert accuracy(got, rows, 0) > 0.97


def test_classifiers_without_labels(spark):
    docs, labels, _ = labelled(spark, n=20)
    for module in (toxicity, quality_model):
        got = module.score_documents(docs, module.train(docs, labels.limit(0))).collect()
        assert {r["score"] for r in got} == {0.5}
        assert module.score_documents(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0


def test_trees_equal_a_walk_by_hand():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 4)), (rng.random(500) < 0.5).astype(float)
    t = quality_model.fit_trees(x, y, trees=5, depth=3)
    for row, margin in zip(x[:50], t.margin(x[:50])):
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += v[node - len(f)]
        assert margin == pytest.approx(total)


def test_statistics_of_one_text_do_not_depend_on_the_batch():
    texts = [b"", b"One two two.\nOne two two.\n", "é ü".encode(), b"x" * 100, b"A B C " * 50]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    both = features(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for k, t in enumerate(texts):
        assert np.allclose(features(np.frombuffer(t, np.uint8), np.array([0, len(t)])), both[k : k + 1])
    assert both.shape == (5, len(NAMES)) and not both[0].any()


def test_training_sample_is_bounded_by_rows(spark):
    """An id that repeats with several texts is one row, whatever the order; null labels and ids teach nothing."""
    from tapegrade.llm.labelled import training_sample

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for order in (docs, docs.orderBy("text"), docs.orderBy("doc_id", docs["text"].desc())):
        got = sorted(tuple(r) for r in training_sample(order, labels, "toxic", 10).collect())
        assert got == [(1, "a", 1), (2, None, 0)]
    assert training_sample(docs, labels, "toxic", 1).count() == 1


def test_a_worker_keeps_its_encoder_but_no_cuts():
    path = model()
    with bpe_pieces.at_work(path) as e:
        e.memory.learn(set(e.cuts("words that are encoded once")))
        first = [e.memory[c] for c in e.cuts("words that are encoded once")]
        assert e.memory
    assert not e.memory
    with bpe_pieces.at_work(path) as again:
        assert again is e and [e.memory[c] for c in e.cuts("words that are encoded once")] == first
    with pytest.raises(KeyError), bpe_pieces.at_work(path) as e:
        e.memory.learn(set(e.cuts("lost")))
        raise KeyError
    assert not e.memory


def test_other_work_drops_the_encoder():
    from tapegrade.llm import common

    with bpe_pieces.at_work(model()) as e:
        pass
    assert bpe_pieces.encoder(model()) is e
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not bpe_pieces._encoders and not common._powers


def test_remembered_cuts_stay_few():
    draw = random.Random(3)
    e = bpe_pieces.Encoder(model())
    for _ in range(13):
        e.memory.learn({"▁" + "".join(draw.choices("abcdefghijklmnopqrst", k=9)) for _ in range(8_000)})
    assert 0 < len(e.memory) <= 100_000


def test_more_cuts_than_are_remembered_take_no_single_walks():
    import pyarrow as pa
    import sentencepiece

    sp, draw = sentencepiece.SentencePieceProcessor(model_file=model()), random.Random(5)
    words = list({"".join(draw.choices("abcdefghijklmnopqrst", k=8)) for _ in range(120_000)})
    texts = [" ".join(words[k : k + 1000]) + ".\n" + " ".join(words[:300]) + " é\n\n€uro \u4e16 \n" for k in range(0, len(words), 1000)] + ["", None, "\n", " \n ", "a\n"]
    e, single = bpe_pieces.Encoder(model()), []
    alone = e.cut_ids
    e.cut_ids = lambda cut: single.append(cut) or alone(cut)
    said = list(e.encode_each(pa.record_batch({"text": pa.array(texts)})))
    assert len(single) < 1000
    assert said == [",".join(map(str, sp.encode(t or ""))) for t in texts]
    assert [e.decode_shown(s) for s in said] == [sp.decode(sp.encode(t or "")) for t in texts]
    assert len(e.memory) <= 100_000 and len(e.memory.older) <= 100_000 and len(e.compatible) <= 1 << 17
