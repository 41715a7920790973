"""Classifier, language model, top-k search and the pipeline."""

import math
import random
import zlib
from collections import Counter

import compare
import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import classlm, hamming, quality, wordclasses
from tidemark.llm.queries import ORACLE, QUERIES, op7_class_lm, op8_quality

SF = "/root/testdata/sf0.001"


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def documents(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert compare.differences(ours, compare.connect(SF).execute(ORACLE[name]).df()) == ""


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality(spark, sf).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in tested]) > 0.95
    assert np.mean([a for a, b in tested if b]) > 0.97


def test_quality_edges(spark, docs, clashing):
    frame = clashing(docs(None, "", "a b c", "a b c", "x" * 200_000, (None, "word", "s")))
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(frame.drop("score"), quality.train(frame, none)).collect()
    assert len(scored) == 6 and all(r.score > 0.99 for r in scored)
    odd = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    model = quality.train(frame, odd)
    assert all(0 < r.score < 1 for r in quality.score(frame.drop("score"), model).collect())
    assert quality.score(frame.drop("score").limit(0), model).collect() == []


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def brute_model(texts):
    """Classes and probabilities from whole counts, without lookups and joins."""
    train = [classlm.tokens(t) for t in texts]
    counts = Counter(w for words in train for w in words)
    clustered = [w for w, _ in sorted(((w, n) for w, n in counts.items() if w), key=lambda c: (-c[1], c[0]))][: classlm.CLUSTER_WORDS]
    number = {w: i for i, w in enumerate(clustered)} | {b"": len(clustered)}

    def num(w):
        return number.get(w, len(clustered) + 1 + classlm.form(w))

    size = len(clustered) + 1 + classlm.FORMS
    pairs = np.zeros((size, size), np.int64)
    for words in train:
        for a, b in zip([b"", *words], words):
            pairs[num(a), num(b)] += 1
    assigned = classlm.exchange(pairs, len(clustered))
    return counts, assigned, num, pairs


def test_language_model_query(spark):
    texts = documents(spark)
    rows = {r.doc_id: r for r in op7_class_lm(spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    train = [t for i, t in texts.items() if crc(i) % 10]
    counts, assigned, num, pairs = brute_model(train)
    total, different = sum(counts.values()), len(counts)
    classes = classlm.CLASSES + 1 + classlm.FORMS
    table = np.zeros((classes, classes))
    np.add.at(table, (assigned[:, None].repeat(len(pairs), 1), assigned[None, :].repeat(len(pairs), 0)), pairs)
    share = (table.sum(0) + 0.1) / (table.sum() + 0.1 * classes)
    step = (table + classlm.PULL * share) / (table.sum(1, keepdims=True) + classlm.PULL)
    class_tokens, class_words = Counter(), Counter()
    for w, n in counts.items():
        class_tokens[assigned[num(w)]] += n
        class_words[assigned[num(w)]] += 1

    def emission(w):
        c = assigned[num(w)]
        if c < classlm.CLASSES:
            return counts[w] / class_tokens[c]
        if c == classlm.CLASSES:
            return 1.0
        return (counts[w] + 0.1) / (class_tokens[c] + 0.1 * (class_words[c] + 1))

    for i, text in texts.items():
        words, r = classlm.tokens(text), rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(i) % 10 == 0, len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (different + 1))) for w in words)
        own = sum(math.log10(step[assigned[num(a)], assigned[num(b)]] * emission(b)) for a, b in zip([b"", *words], words))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 5, (48, 48))
    assigned = classlm.exchange(pairs, 40)
    assert sorted(set(assigned[40:])) == [classlm.CLASSES + i for i in range(8)] and assigned[:40].max() < classlm.CLASSES


def likelihood(pairs, assigned, classes):
    table = np.zeros((classes, classes))
    for i, a in enumerate(assigned):
        for j, b in enumerate(assigned):
            table[a, b] += pairs[i, j]
    return sum(classlm._phi(x).sum() * sign for x, sign in ((table, 1), (table.sum(0), -1), (table.sum(1), -1)))


def test_no_single_move_betters_the_exchange():
    pairs = np.random.default_rng(7).integers(0, 9, (14, 14))
    assigned = classlm.exchange(pairs, 11, classes=3, sweeps=50)
    best = likelihood(pairs, assigned, 6)
    for w in range(11):
        for c in range(3):
            moved = assigned.copy()
            moved[w] = c
            assert likelihood(pairs, moved, 6) <= best + 1e-6


def test_exchange_finds_alternating_words():
    pairs = np.zeros((8, 8), np.int64)
    pairs[:4, 4:] = 5
    pairs[4:, :4] = 5
    a = classlm.exchange(pairs, 8, classes=2)
    assert len(set(a[:4])) == len(set(a[4:])) == 1 and a[0] != a[4]


def test_exchange_sweeps_until_none_moves():
    pairs = np.random.default_rng(2).poisson(0.2, (300, 300))
    assert (classlm.exchange(pairs, 296) == classlm.exchange(pairs, 296, sweeps=500)).all()


def test_language_model_edges(docs, clashing):
    frame = clashing(docs(None, "", "A a\tb", "a " * 50_000, (None, "unknown words", "s"), (2, "A a\tb", "s")))
    found = classlm.score(frame, classlm.train(frame)).collect()
    assert len(found) == 6 and all(np.isfinite([r.base_score, r.score]).all() for r in found)
    assert sorted(r.n_tokens for r in found) == [1, 1, 3, 4, 4, 50_001]
    none = docs("x").limit(0)
    model = classlm.train(none)
    assert classlm.score(none, model).collect() == []
    (row,) = classlm.score(docs("new words"), model).collect()
    assert (row.n_known, row.base_score) == (0, 0.0)


def alternating(docs, n_words=300, times=60):
    """Texts in which words of two kinds take turns, rarer than 1,100 others; two are held out: in turns, and kind by kind."""
    rng = random.Random(3)
    kinds = [[f"{kind}{i}" for i in range(n_words)] for kind in "xy"]
    turns = [" ".join(rng.choice(kinds[j % 2]) for j in range(100)) for _ in range(times)]
    every = [" ".join(w for pair in zip(rng.sample(kinds[0], n_words), rng.sample(kinds[1], n_words)) for w in pair) for _ in range(2)]
    others = [" ".join(rng.sample([f"z{i}" for i in range(1100)], 1100)) for _ in range(40)]
    ids = [i for i in range(2000) if crc(i) % 10]
    held = [i for i in range(2000) if crc(i) % 10 == 0][:2]
    tested = [w for pair in zip(kinds[0][:40], kinds[1][:40]) for w in pair]
    texts = [" ".join(tested), " ".join(tested[::2] + tested[1::2])]
    return docs(*((i, x, "s") for i, x in [*zip(ids, turns + every + others), *zip(held, texts)])), held


@pytest.mark.parametrize("in_tasks", [False, True])
def test_all_words_seen_twice_have_classes_by_exchange(docs, monkeypatch, in_tasks):
    if in_tasks:
        monkeypatch.setattr(classlm, "HERE_TOKENS", 0)
        monkeypatch.setattr(classlm, "PART_TOKENS", 5_000)
        monkeypatch.setattr(classlm, "LOOKUP_WORDS", 100)
        monkeypatch.setattr(wordclasses, "FETCHED", 3_000)
    frame, (in_turns, by_kind) = alternating(docs)
    scores = {r.doc_id: r for r in classlm.score(frame, classlm.train(frame)).collect()}
    assert scores[in_turns].base_score == pytest.approx(scores[by_kind].base_score)
    assert scores[in_turns].score > scores[by_kind].score + 5


def test_exchange_in_tasks_ends_when_no_word_gains(spark, monkeypatch):
    rng = np.random.default_rng(5)
    often, classes = 60, 4
    size, total, end = often + 3, classes + 2, often + 1
    texts = [np.append(rng.integers(0, often + 1, 40), end).astype(np.int32) for _ in range(60)]
    frame = spark.createDataFrame([(t.tobytes(),) for t in texts], "words binary").repartition(3)
    pairs = np.zeros((size, size), np.int64)
    for t in texts:
        np.add.at(pairs, (np.append(end, t[:-1]), t), 1)
    for fetched in (0, 10**6):
        monkeypatch.setattr(wordclasses, "FETCHED", fetched)
        assigned = np.array([*(np.arange(often) % classes), classes + 1, classes, classes + 1], np.uint8)
        start = assigned.copy()
        parts = wordclasses.neighbours(frame, size, end, often, 5)
        table = wordclasses.classes_of(parts, 5, often, classes, assigned, total)
        whole = np.zeros((total, total))
        np.add.at(whole, (assigned[:, None].repeat(size, 1), assigned[None, :].repeat(size, 0)), pairs)
        assert (table == whole).all() and (assigned[often:] == start[often:]).all()
        best = wordclasses.likelihood(whole)
        for w in range(often):
            for c in range(classes):
                moved = assigned.copy()
                moved[w] = c
                assert likelihood(pairs, moved, total) <= best + 1e-6


def brute_top(vectors, queries, k):
    out = {}
    for q, v in queries:
        near = {(sum((a > 0) != (b > 0) for a, b in zip(v, w)), i) for i, w in vectors if i != q}
        out[q] = [(i, d) for d, i in sorted(near)[:k]]
    return out


def test_top_k_with_hot_codes_ties_and_bad_rows(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-1.0, 1.0]) for _ in range(64)]) for i in range(120)]
    vectors += [(i, vectors[0][1]) for i in range(200, 290)] + [(5, vectors[5][1])]
    bad = [(None, vectors[0][1]), (300, None), (301, [1.0]), (302, [])]
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame(vectors + bad, schema).selectExpr("*", "'x' AS code", "'y' AS id")
    asked = [v for v in vectors if v[0] % 3 == 0]
    queries = spark.createDataFrame(asked + bad, schema)
    brute = brute_top(vectors, asked, 7)
    for blocks in ({}, {"block_codes": 16, "block_queries": 8}):
        found = {}
        for r in hamming.top_k(frame, queries, 7, **blocks).collect():
            found.setdefault(r.query_id, {})[r.rank] = (r.neighbor_id, r.distance)
        assert {q: [near[i + 1] for i in range(len(near))] for q, near in found.items()} == brute
    assert hamming.top_k(frame.limit(0), queries.limit(0)).collect() == []
    assert hamming.top_k(frame.where("vec_id = 1"), frame.where("vec_id = 1")).collect() == []


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, rows = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns, name
        kept = frame.count()
        assert kept <= rows, name
        rows = kept
    left = {r.doc_id for r in frame.collect()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == left
    assert all(r.length & (r.length - 1) == 0 for r in packed)


def test_pipeline_drops_copies_leaks_and_keeps_the_rest(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(6)]
    near = plain[0].replace("w0x7 ", "changed ")
    rows = [(1, plain[0], "s"), (2, plain[1], "s"), (3, near, "s"), (4, plain[1], "s"), (5, plain[2] + " " + bench, "s"), (6, plain[3] + "\n" + plain[0], "s"), (7, "", "s"), (8, None, "s")]
    frame = docs(*rows)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        frame = stage(spark, frame, SF)
    left = {r.doc_id: r for r in frame.collect()}
    assert sorted(left) == [1, 2, 6, 7]
    assert left[6].text == plain[3] and left[6].n_chars == len(plain[3])
