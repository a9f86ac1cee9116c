"""The pipeline's stages against brute-force versions, each on what the one before kept."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapegrade.llm import mixing, toxicity
from tapegrade.llm.queries import tokenizer_path

from .test_text_ops import WORD, components, none_last

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows after each stage, the first being the documents (a part of them, for brute force)."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", None, 0), (9002, "", None, "src1", 0), (None, "a row without an id " * 5, "en", "src2", 100)], docs.schema)
    docs = docs.unionByName(extra)
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)


def test_toxic_documents_go(spark, sf, stages):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(spark.createDataFrame(stages[0], docs.schema), labels)
    keep = [r for r in stages[0] if model.score(np.frombuffer((r["text"] or "").encode(), np.uint8), np.array([0, len((r["text"] or "").encode())]))[0] < 0.5]
    assert ids(keep) == ids(stages[1])


def test_one_document_of_each_group_stays(stages):
    named = components([(r["doc_id"], r["text"]) for r in stages[1]])
    assert ids(stages[2]) == sorted((i is None, i) for i, _, c in named if i is None or i == c)


def kept_at_five_words(rows):
    """Ids of the smallest member of each component over five-word shingles and a similarity of 0.8, by brute force."""
    sets = []
    for _, t in rows:
        w = WORD.findall(t.lower())
        sets.append({tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    return sorted(min(i for (i, _), h in zip(rows, group) if h == g) for g in set(group))


def test_near_copies_link_at_five_words_and_four_fifths(spark, sf):
    rows = []
    for base, (words, edits, added) in enumerate([(190, 4, 0), (190, 5, 0), (100, 0, 20), (100, 0, 24), (100, 0, 28), (3, 1, 0), (60, 1, 0), (60, 2, 0)]):
        w = [f"b{base}x{k}" for k in range(words)]
        copy = list(w)
        for e in range(edits):
            copy[(e + 1) * words // (edits + 1)] = f"edit{base}x{e}"
        rows += [(10 * base + 1, " ".join(w)), (10 * base + 2, " ".join(copy + [f"more{base}x{k}" for k in range(added)]))]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, sf).collect())
    assert got == kept_at_five_words(rows)
    # four edits of 190 words, and a fifth added: at four words and 85 % both copies would stay
    assert 2 not in got and 22 not in got


def test_repeated_ids_are_judged_by_their_texts(spark, sf):
    """Id 2 has a copy of document 1 and a text of its own: the copy goes and the text stays, in either order; empty tables stay empty."""
    first = " ".join(f"w{k}" for k in range(60))
    rows = [(1, first), (2, first + " more"), (2, "a text of its own with seven words"), (3, ""), (3, None), (4, "one"), (5, "one"), (None, first)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    want = [(1, first), (2, "a text of its own with seven words"), (3, None), (4, "one"), (None, first)]
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in order], schema).coalesce(1), sf).collect()
        assert sorted(((r["doc_id"], r["text"] or None) for r in got), key=str) == sorted(want, key=str)
    assert corpus_pipeline.one_of_each_group(spark, spark.createDataFrame([], schema), sf).count() == 0


def test_repeated_bytes_are_cut(stages):
    width, first = 50, {}
    rank = lambda i: float("inf") if i is None else i
    for r in stages[2]:
        b = (r["text"] or "").encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], float("inf")), rank(r["doc_id"]))
    want = []
    for r in stages[2]:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < rank(r["doc_id"]):
                gone[k : k + width] = True
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert none_last([tuple(r) for r in stages[3]]) == none_last(want)


def test_mix_repeats_whole_documents_towards_the_targets(stages):
    size = lambda r: len((r["text"] or "").encode().split())
    total, taken = {}, {}
    for rows, sums in ((stages[3], total), (stages[4], taken)):
        for r in rows:
            sums[r["source"]] = sums.get(r["source"], 0) + size(r)
    for s, target in mixing.targets(list(total.items())).items():
        assert abs(taken.get(s, 0) - target) <= 0.02 * target + 2
    count = {}
    for r in stages[4]:
        count[tuple(r)] = count.get(tuple(r), 0) + 1
    assert set(count) <= {tuple(r) for r in stages[3]} and max(count.values()) <= 2


def test_encoding_equals_the_library(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r["doc_id"], len(e := sp.encode(r["text"] or "")), digest(",".join(map(str, e))), digest(sp.decode(e))) for r in stages[4]]
    assert none_last([tuple(r) for r in stages[5]]) == none_last(want)


def test_run_equals_the_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 0


CLASHING = {"size": 7, "copies": 8, "times": 9, "kept": "k", "spans": "s", "_k": 1, "_h": 2, "rest": "r", "n_bytes": 3, "node": 4, "h": 5, "time": 6}


def test_further_columns_pass_through_all_stages(spark, sf, stages):
    docs = spark.createDataFrame(stages[0][:120] + stages[0][-3:], spark.read.parquet(f"{sf}/documents.parquet").schema)
    wide = docs
    for name, value in CLASHING.items():
        wide = wide.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, sf), stage(spark, wide, sf)
        assert got.columns == COLUMNS + list(CLASHING)
        rows = got.collect()
        assert all(r[c] == v for r in rows for c, v in CLASHING.items())
        order = lambda found: sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str)
        assert order(rows) == order(plain.collect()) and rows, name


def test_an_empty_table_passes_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
