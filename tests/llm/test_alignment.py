import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries
from tidemark.llm.alignment import Fragment, compose, fragment, whole

A, B = alignment.default_tokenizers()


def brute(texts):
    """Groups and links by walking over every byte; no fragments, no cuts."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    codec = alignment.Codec(A, B)
    docs, counts = [], Counter()
    for text in texts:
        raw = (" " + text).encode() if text else b""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if b"".join(codec.a_bytes[i] for i in x) != raw or b"".join(codec.b_bytes[i] for i in y) != raw:
            x, y = [], []
        of_a = [k for k, i in enumerate(x) for _ in codec.a_bytes[i]]
        of_b = [k for k, i in enumerate(y) for _ in codec.b_bytes[i]]
        links = [(x[i], y[j]) for i, j in sorted(set(zip(of_a, of_b)))]
        groups, start = [], (0, 0)
        for k in range(1, len(of_a) + 1):
            if k == len(of_a) or (of_a[k] != of_a[k - 1] and of_b[k] != of_b[k - 1]):
                i, j = of_a[k - 1] + 1, of_b[k - 1] + 1
                groups.append(",".join(map(str, x[start[0] : i])) + "|" + ",".join(map(str, y[start[1] : j])))
                start = i, j
        counts.update(links)
        docs.append((len(x), len(y), groups, links))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), ";".join(groups))
        for n_a, n_b, groups, links in docs
    ]


def rows(df):
    names = "n_a n_b n_groups n_links n_best count_sum groups".split()
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


TEXTS = [
    "Hello tokenizers, über-naïve 😀😀 text.\nAnother line",
    None,
    "",
    " ",
    "  two  spaces   inside \n\n and more\t tabs  ",
    "<|endoftext|> <s> </s> <0x0A>",
    "a ▁ block is lost",
    "\x00\r\n\x85　ﬁ ５ 日本語のテキスト",
    "x" * 700 + " " + "word " * 200,
    "Hello tokenizers, über-naïve 😀😀 text.\nAnother line",
]


def test_alignment_edges(docs, clashing):
    found = rows(alignment.align(clashing(docs(*TEXTS))))
    assert [found[i] for i in range(len(TEXTS))] == brute(TEXTS)
    assert found[1] == found[2] == found[6] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.align(docs("x").limit(0)).collect() == []


def test_alignment_in_byte_ranges_and_with_rare_pairs(docs):
    long = [*TEXTS, " ".join(random.Random(3).choices(["don't", "üñí", "日本語", "end.\n", "the", "x y"], k=400))]
    want = brute(long)
    cut = rows(alignment.align(docs(*long), chunk_bytes=16, fan=2, hot_pairs=5))
    assert [cut[i] for i in range(len(long))] == want
    rare = rows(alignment.align(docs(*long), hot_pairs=1))
    assert [rare[i] for i in range(len(long))] == want


def test_composition_is_associative():
    rng, size_b = random.Random(5), 1000
    for _ in range(300):
        length = rng.randint(1, 40)
        ends = [sorted({*rng.sample(range(1, length + 1), rng.randint(0, length)), length}) for _ in "ab"]
        a, b = ([rng.randrange(1000) for _ in e] for e in ends)
        borders = sorted(rng.sample(range(length + 1), min(length + 1, rng.randint(0, 6))))
        parts = []
        for low, high in zip([0, *borders], [*borders, length]):
            x, x_ends = alignment._between(a, ends[0], low, high)
            y, y_ends = alignment._between(b, ends[1], low, high)
            parts.append(fragment(x, x_ends, y, y_ends, size_b))
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [compose(parts[k], parts[k + 1], size_b)]
        one = whole(compose(Fragment(), parts[0], size_b), size_b)
        groups, pairs = alignment.close(a, ends[0], b, ends[1], size_b)
        assert (one[0], one[1].tolist()) == (";".join(groups), pairs)


def test_ranges_cover_a_text_once():
    for lengths in ([5], [5, 5, 5], [1, 100, 1], [3] * 50, [16, 16], [40, 1, 40]):
        cut = alignment.ranges(lengths, 16)
        assert cut[0][2] == 0 and cut[-1][3] == sum(lengths)
        assert all(x[3] == y[2] for x, y in zip(cut, cut[1:]))
        for i, j, low, high in cut:
            assert sum(lengths[:i]) <= low and sum(lengths[:j]) >= high


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_alignment_query(spark, sf):
    path = f"/root/testdata/{sf}"
    texts = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in texts])
    found = {r.doc_id: r for r in queries.op12_alignment(spark, path).collect()}
    for r, (n_a, n_b, n_groups, n_links, n_best, total, groups) in zip(texts, want):
        x = found[r.doc_id]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum) == (n_a, n_b, n_groups, n_links, n_best, total)
        assert x.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_a_worker_loads_its_tokenizers_once():
    first = alignment.codec_of((A, B), with_groups=False)
    assert first.texts(["some words"]) and first.known and not first.groups
    again = alignment.codec_of((A, B))
    assert again is first and not again.known and again.texts(["some words"]) and again.groups


def test_groups_of_words_are_kept_together():
    """One column of all words' groups, not a string a word; each is what the word alone gives."""
    codec = alignment.codec_of((A, B))
    cut = codec.texts(["some wörds and some more", None, "", "and words"])
    codec.texts(["others, later"])
    at, ends = codec.places(cut)
    assert len(codec.group_texts()) == len(codec.known) and len(codec.groups) == 1
    assert ends.tolist() == [5, 5, 5, 7]
    for word, groups in zip([*cut[0], *cut[3]], codec.group_texts().take(at).to_pylist(), strict=True):
        a, b = codec.encode(word)
        a_ends, b_ends = (x.tolist() for x in codec.ends(a, b))
        assert groups == ";".join(alignment.close(a, a_ends, b, b_ends, codec.size_b)[0])
