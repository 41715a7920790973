"""The pipeline's line dedup and near-dedup stages against plain Python."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import neardedup, simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_kept(rows):
    """Smallest id of each group of documents linked by Jaccard 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            best = min(label[j] for j in sets if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
            if best < label[i]:
                label[i], changed = best, True
    return {i for i in label if label[i] == i}


def edited(rng, text, words):
    own = text.split()
    for k in rng.sample(range(len(own)), words):
        own[k] = f"edit{rng.randrange(10**9)}"
    return " ".join(own)


@pytest.mark.parametrize("star_from", [2, 32])
def test_stage_drops_near_copies(spark, docs, clashing, monkeypatch, star_from):
    monkeypatch.setattr(neardedup, "STAR_FROM", star_from)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 200, 900]))) for _ in range(12)]
    # one to a few edits each: Jaccard from below 0.8 up to 0.99
    texts += [edited(rng, t, rng.randint(1, max(1, len(t.split()) // 40))) for t in texts for _ in range(5)]
    texts += [None, "", " \n", "a b", "A  b", "a b c", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = brute_kept(rows)
    frame = clashing(docs(*((i, t, "s") for i, t in rows)))
    found = corpus_pipeline.one_of_each_group(spark, frame, "")
    assert found.columns == frame.columns
    assert sorted(r.doc_id for r in found.collect()) == sorted(kept) and len(kept) < 50
    assert corpus_pipeline.one_of_each_group(spark, docs("x").limit(0), "").collect() == []


def test_stage_drops_what_fingerprints_link(spark, docs):
    said = "one two three four five six seven " * 50
    tail = " ".join(f"t{i}" for i in range(20))
    # the majority of the shingles is the same, the sets of the shingles are not
    assert simhash.fingerprint(said) == simhash.fingerprint(said + tail)
    assert 5 * len(shingle_set(said) & shingle_set(said + tail)) < 4 * len(shingle_set(said) | shingle_set(said + tail))
    words = [f"w{i}" for i in range(100)]
    rows = [(1, said, "s"), (2, said + tail, "s"), (3, " ".join(words), "s"), (4, " ".join([*words[:-1], "other"]), "s")]
    found = corpus_pipeline.one_of_each_group(spark, docs(*rows), "").collect()
    assert sorted(r.doc_id for r in found) == [1, 3]


def test_line_stage_drops_only_what_is_empty(spark, docs):
    quoted = [" ".join(f"q{i}x{j}" for j in range(30)) for i in range(6)]
    # four fifths are quoted, and it is the first to hold a line that a later document repeats
    own, repeated = "five own words of it", "its own line said again and again"
    rows = [
        (1, "\n".join(quoted), "s"),
        (2, "\n".join([*quoted, own]), "s"),
        (3, own + "\nand so much more is only written here", "s"),
        (4, "\n".join([repeated] * 9), "s"),
        (5, quoted[0] + "\n \n" + quoted[1] + "\n", "s"),
        (6, " ", "s"),
        (7, None, "s"),
    ]
    left = {r.doc_id: r for r in corpus_pipeline.without_repeated_lines(spark, docs(*rows), "").collect()}
    assert sorted(left) == [1, 2, 3, 4, 6, 7]
    assert (left[2].text, left[2].n_chars) == (own, len(own))
    assert left[3].text == "and so much more is only written here" and left[4].text == repeated


@pytest.mark.parametrize("operator", [neardedup, simhash])
def test_keep_one_with_a_clashing_name(spark, operator):
    rows = [(1, "a b c d e f", "z"), (2, "a b c d e f", "z"), (3, "other words stand here now", "z"), (None, "x y z", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays string")
    assert sorted((r.doc_id or 0, r.stays) for r in operator.keep_one(docs).collect()) == [(0, "z"), (1, "z"), (3, "z")]
