import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import phrases, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in wanted.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], a)
        found = []
        for g, a in wanted.items():
            if inside[g] and 100 * inside[g] >= covered * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, rows=400):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "é", "a\xa0b", "\x1cx", "I", "don't", "日本"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(rows):
        chosen = rng.choices(words, weights, k=rng.randint(0, 40))
        marks = rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"], [20, 1, 1, 2, 1, 1, 1, 1], k=len(chosen))
        out.append((rng.choice(["en", "en", "en", None, "und", ""]), "".join(w + m for w, m in zip(chosen, marks))))
    return [*out, ("en", None), ("en", ""), (None, None), ("fr", "only few words")] + [("en", "New York. City of the")] * 30


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 3, "top": 50, "covered": 80}, {"longest": 2, "bitmap_bits": 64}])
def test_phrases_against_brute_force(spark, clashing, options):
    rows = texts(7)
    docs = clashing(spark.createDataFrame(rows, "lang string, text string")).selectExpr("*", "'x' f", "'x' phrase", "'x' rank")
    found = phrases.mine(docs, **options).collect()
    plain = {k: v for k, v in options.items() if k != "bitmap_bits"}
    assert sorted(map(tuple, found)) == brute(rows, **plain)


def test_phrases_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine(empty).collect() == []
    blank = spark.createDataFrame([(None, None), ("en", " .,\t\n")], "lang string, text string")
    assert phrases.mine(blank).collect() == []
    with pytest.raises(ValueError, match="two words"):
        phrases.mine(empty, longest=1)


def test_scores_beyond_64_bits(spark):
    a, left, right = 10**13, 3 * 10**13, 7 * 10**13
    stream = spark.createDataFrame([("en", "x y", a, [left], [right])], "lang string, phrase string, f long, ls array<long>, rs array<long>")
    assert phrases.scored(stream).first().cut.score == 1_000_000 * a * a // (left * right)


def test_a_long_block_is_counted_in_parts(spark, monkeypatch):
    rows = texts(9, 60)
    batch = phrases.pa.RecordBatch.from_pylist([{"lang": x or "und", "text": y} for x, y in rows])
    whole, parts = Counter(), Counter()
    for counts, limit in ((whole, 10**9), (parts, 50)):
        monkeypatch.setattr(phrases, "BLOCK_WORDS", limit)
        for out in phrases._counter([])(iter([batch])):
            for r in out.to_pylist():
                counts[r["lang"], r["phrase"]] += r["f"]
    assert whole == parts


def test_joins_read_sorted_streams(spark):
    stream = spark.createDataFrame([("en", "x y", 10)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", w, 20, [], []) for w in "xy"], "lang string, phrase string, f long, ls array<long>, rs array<long>")
    plan = phrases.with_parts(stream, words, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "HashJoin" not in plan


def test_phrases_query_and_sql(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("lang", "text").collect()]
    found = sorted(map(tuple, queries.op13_collocations(spark, path).collect()))
    assert found == brute(rows) and found
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW documents AS FROM '{path}/documents.parquet'")
        assert sorted(sql.execute(queries.OP13_SQL).fetchall()) == found
