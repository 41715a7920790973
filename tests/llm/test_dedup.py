"""SimHash and line dedup against plain Python, with hot groups of near copies."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import linededup, simhash
from tidemark.llm.components import components
from tidemark.llm.queries import op6_simhash, op10_line_dedup

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id reachable over fingerprints within two bits."""
    name = dict(prints)
    label = {i: i for i in name}
    changed = True
    while changed:
        changed = False
        for i in name:
            best = min(label[j] for j in name if (name[i] ^ name[j]).bit_count() <= 2)
            if best < label[i]:
                label[i], changed = best, True
    return label


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    label = brute_components(prints)
    rows = op6_simhash(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", label[r.doc_id])


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('a é b') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("a é b".encode(), 42)


@pytest.mark.parametrize("hot_key", [2, 32])
def test_links_join_what_brute_force_joins(spark, monkeypatch, hot_key):
    monkeypatch.setattr(simhash, "HOT_KEY", hot_key)
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        values |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(25)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    found = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    mask = (1 << 64) - 1
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    def partition(pairs):
        for v in values:
            parent[v] = v
        for a, b in pairs:
            parent[root(a)] = root(b)
        groups = {}
        for v in values:
            groups.setdefault(root(v), set()).add(v)
        return {frozenset(g) for g in groups.values()}

    own = [(r.a & mask, r.b & mask) for r in found]
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    if hot_key == 32:
        assert all((a ^ b).bit_count() <= 4 for a, b in own)
    assert partition(own) == partition(near)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(-5, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == -5 for i in range(61)) and all(found[100 + i] == 100 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges_of_near_duplicates(docs, clashing):
    rows = [(5, None, "s"), (3, "", "s"), (9, " \t\n", "s"), (4, "A b", "s"), (2, "a  B", "s"), (2, "a  B", "s"), (None, "a b", "s"), (None, "alone here", "s")]
    found = simhash.near_duplicates(clashing(docs(*rows))).collect()
    assert len(found) == len(rows)
    by_print = {}
    for r in found:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by_print["0" * 16] == {3} and by_print[f"{brute_fingerprint('a b'):016x}"] == {2}
    kept = simhash.keep_one(docs(*rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 3] and len(kept) == 3
    assert simhash.keep_one(docs("x").limit(0)).collect() == []


def brute_lines(rows):
    """(row, removed lines) by comparing every line with all earlier ones."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = [], {}
    for k in order:
        gone = []
        for number, line in enumerate((rows[k][1] or "").split("\n")):
            s = set(line.encode().lower().split())
            if not s:
                continue
            if any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                gone.append(number)
            seen.append(s)
        out[k] = gone
    return out


def test_line_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    brute = brute_lines(rows)
    found = {r.doc_id: r for r in op10_line_dedup(spark, SF).collect()}
    for k, (i, text) in enumerate(rows):
        assert found[i].removed_lines == ",".join(map(str, brute[k])), i
        assert found[i].n_lines == len(text.split("\n"))


@pytest.mark.parametrize("broadcast_rows, meet", [(0, 1024), (0, 4), (500_000, 4)])
def test_lines_of_hot_groups(docs, clashing, monkeypatch, broadcast_rows, meet):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(linededup, "MEET", meet)
    rng = random.Random(5)
    base = [f"word{i}" for i in range(20)]
    rows = []
    for i in range(60):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(20)] = f"other{rng.randrange(50)}"
        lines = [" ".join(near), "short line", " ".join(rng.choices(base, k=8)), f"unique {i} a b c d"]
        rows.append((i, "\n".join(lines), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "a B\tc d e\n\na b C d e\n", "s")]
    brute = brute_lines(rows)
    found = {r.doc_id: r for r in linededup.dedup_lines(clashing(docs(*rows))).collect()}
    for k, (i, text, _) in enumerate(rows):
        assert found[i].removed_lines == brute[k]
        left = None if text is None else "\n".join(l for n, l in enumerate(text.split("\n")) if n not in brute[k])
        assert found[i].text == left
    assert found[102].text == "a B\tc d e\n\n" and found[100].n_lines == 0


def test_line_edges(docs):
    long_line = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long_line + "\nx y z v w", "s"), (1, long_line + "\nx y z v w", "s"), (None, "x y z v w", "s"), (2, long_line, "s")]
    found = linededup.dedup_lines(docs(*rows)).collect()
    assert len(found) == 4
    removed = sorted((r.doc_id is not None, r.doc_id or 0, r.removed_lines) for r in found)
    # rows of one id and text are one document; the null id comes first
    assert removed == [(False, 0, []), (True, 1, [1]), (True, 1, [1]), (True, 2, [0])]
    assert linededup.dedup_lines(docs("x").limit(0)).collect() == []


def test_line_ids_and_names(spark):
    few = " ".join(["la", "li", "lo", "lu"] * 50)
    rows = [("b", f"{few}\nclick here"), ("a", f"x\n{few}\n \n"), ("c", "Click HERE\nla li lo lu le\n \n"), (None, "x")]
    names = "own row key other first place done removed_lines n_lines _line_row"
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", *(f"'x' AS {n}" for n in names.split()))
    found = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert {i: r.removed_lines for i, r in found.items()} == {None: [], "a": [0], "b": [0], "c": [0, 1]}
    assert found["c"].text == " \n" and found["c"].row == found["c"]._line_row == "x" and found["c"].n_lines == 4


def test_prefix_is_long_enough():
    for n in range(1, 200):
        overlap = -(-4 * n // 5)
        assert linededup.prefix_length(n) == n - overlap + 1
    assert (linededup.prefix_length(np.arange(1, 200)) == [linededup.prefix_length(n) for n in range(1, 200)]).all()


@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_meeting_over_batches(step):
    """Pairs of words within the bound, rows of the others, however the rows are cut into batches."""
    rng = random.Random(step)
    rows = [(w, k, (10 << 32), 0) for w, n in enumerate([1, 2, 32, 33, 90, 3, 1, 40]) for k in sorted(rng.sample(range(200), n))]
    rows += [(9, 5, 10 << 32, 0), (9, 5, 10 << 32, 0), (9, 6, 10 << 32, 0), (10, 7, 10 << 32, 0), (10, 7, 10 << 32, 0)]
    names = ["word", "key", "n_at", "parity"]
    batches = [pa.table(list(map(pa.array, zip(*rows[i : i + step]))), names).to_batches()[0] for i in range(0, len(rows), step)]
    pairs, large = set(), set()
    for batch in linededup._meet(iter(batches), 32):
        for r in batch.to_pylist():
            pairs.add((r["key"], r["with"])) if r["word"] is None else large.add((r["word"], r["key"]))
    keys = {w: sorted({r[1] for r in rows if r[0] == w}) for w, *_ in rows}
    assert large == {(w, k) for w, own in keys.items() if len(own) > 32 for k in own}
    assert pairs == {(a, b) for own in keys.values() if len(own) <= 32 for a in own for b in own if a < b}


def test_order_by_rarity():
    rng = np.random.default_rng(1)
    line, level = np.sort(rng.integers(0, 50, 4000)), rng.integers(0, 3, 4000)
    for word in (rng.integers(0, 1 << 63, 4000).astype(np.uint64), np.arange(4000, 0, -1).astype(np.uint64)):
        assert (linededup._by_rarity(line, level, word) == np.lexsort((word, level, line))).all()


def test_lengths_apart_do_not_meet():
    n = np.array([8, 9, 10, 10, 11, 13, 20, 24, 26])
    rows = np.stack([np.ones(9, np.int64), np.arange(9), n << 32, np.zeros(9, np.int64)])
    found = {(a, b) for a, b, _ in linededup._pair_sets(rows).T.tolist()}
    assert found == {(a, b) for a in range(9) for b in range(a + 1, 9) if 5 * n[a] >= 4 * n[b]}


def test_pairs_tell_how_many_words_they_share():
    rows = np.stack([np.array([1, 1, 2, 2, 2]), np.array([7, 5, 5, 7, 6]), np.full(5, 10 << 32), np.zeros(5, np.int64)])
    assert linededup._pair_sets(rows).T.tolist() == [[5, 6, 1], [5, 7, 2], [6, 7, 1]]


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(linededup, "PART_BYTES", 10)
    monkeypatch.setattr(linededup, "PART_ROWS", 3)
    texts = ["aaaa", "bbbb", "cccc", "d" * 50, None, "", "e", "f", None, None]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    parts = [p.column(0).to_pylist() for p in linededup.text_parts(iter([batch, batch.slice(0, 0)]))]
    assert sum(parts, []) == texts
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)


def test_lines_are_read_as_arrays():
    """Owner, number and words of each line as plain Python finds them; a word has one hash wherever it stands."""
    rng = random.Random(5)
    own = ["a", "B", "b", "ab\0", "ab", "é", "É", "x" * 8, "x" * 9, "Y" * 16, "y" * 17, "z" * 63, "z" * 64, "z" * 65, "w" * 300]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\n \n", "\v", "\f", "\x1f", "\x85"]
    texts = [None, "", "\n", " ", "end\n", "\nstart", *("".join(rng.choice(own + gaps) for _ in range(rng.randrange(60))) for _ in range(200))]
    want = []
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").encode().lower().split(b"\n")):
            if line.split():
                want.append((i, k, frozenset(line.split())))
    levels = np.random.default_rng(2).integers(0, 3, 1 << linededup.BUCKET_BITS).astype(np.int8)
    of_hash = {}
    for given in (None, levels):
        lines = linededup._Lines(pa.array(texts), given)
        assert list(zip(lines.owner.tolist(), lines.number.tolist(), lines.size.tolist())) == [(i, k, len(words)) for i, k, words in want]
        for (_, _, words), low, n in zip(want, lines.starts.tolist(), lines.size.tolist()):
            assert len(set(lines.hashes[low : low + n].tolist())) == n
            ranks = list(zip(lines.level[low : low + n].tolist(), lines.hashes[low : low + n].tolist()))
            assert ranks == sorted(ranks)
            for h in lines.hashes[low : low + n].tolist():
                of_hash[h] = of_hash.get(h, words) & words
        assert len({k for k in lines.key.tolist()}) == len({words for *_, words in want}) == int(lines.first.sum())
    # what all lines of a hash share holds the word, and there are as many hashes as words
    assert all(of_hash.values()) and len(of_hash) == len(set().union(*(words for *_, words in want)))
    empty = linededup._Lines(pa.array([], pa.string()))
    assert len(empty.owner) == len(empty.hashes) == 0


@pytest.mark.parametrize("step", [3, 10_000])
def test_postings_of_a_word_meet_in_any_order(step):
    rows = [(1, k, n << 32, 0) for k, n in ((4, 10), (2, 9), (4, 10), (3, 20), (1, 11), (2, 9))]
    names = ["word", "key", "n_at", "parity"]
    batches = [pa.table(list(map(pa.array, zip(*rows[i : i + step]))), names).to_batches()[0] for i in range(0, len(rows), step)]
    found = [(r["key"], r["with"]) for b in linededup._meet(iter(batches), 32) for r in b.to_pylist()]
    assert sorted(found) == [(1, 2), (1, 4), (2, 4)]


def postings_of(monkeypatch, texts, documents):
    """Rows of _postings for one part, whatever the rarity."""
    monkeypatch.setattr(linededup, "_order", lambda source: SimpleNamespace(alias=str))
    source = pa.record_batch([pa.array(documents, pa.int64()), pa.array(texts)], ["document", "text"])

    class Source:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return [b for b in run(iter([source]))]

    return np.concatenate([np.stack([c.to_numpy() for c in b.columns]) for b in linededup._postings(Source(), np.ones(1 << linededup.BUCKET_BITS, np.int8))], axis=1)


def test_group_of_near_copies_has_one_trial_a_set(monkeypatch):
    """Rows do not grow with the square of the group; the packed pairs are all that may match, each from its later set."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(20)], []
    for i in range(60):
        words = list(base)
        for _ in range(i % 3):
            words[rng.randrange(20)] = f"o{rng.randrange(1000)}"
        texts.append(" ".join(words + [f"own{i}"]))
    documents = rng.sample(range(1000), 60)
    rows = postings_of(monkeypatch, texts + texts[:1], documents + [-1])
    names = ["word", "key", "n_at", "parity", "document"]
    rows = rows[:, np.lexsort(rows[:1])]
    trials, rest = {}, set()
    for batch in linededup._meet(iter(pa.table(list(map(pa.array, rows)), names).to_batches()), 1024):
        for r in batch.to_pylist():
            assert r["word"] is None
            trials.setdefault(r["key"], set()).add(r["with"])
            rest |= set(zip(*np.frombuffer(r["rest"], np.int64).reshape(2, -1).tolist())) if r["rest"] else set()
    keys = [int(k) for k in linededup._Lines(pa.array(["\n".join(texts)])).key.view(np.int64)]
    place = dict(zip(keys, [-1, *documents[1:]]))
    sets = {k: set(t.split()) for k, t in zip(keys, texts)}
    similar = {(a, b) for a in sets for b in sets if place[a] > place[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(similar) > 500 and similar <= rest
    assert all(place[a] > place[b] for a, b in rest) and {a for a, _ in similar} <= trials.keys()
    assert all(len(of) == 1 for of in trials.values()) and {(a, b) for a, of in trials.items() for b in of} <= rest


def test_packed_pairs_of_few_and_many_keys(spark, monkeypatch):
    packed = np.array([[1, 1, 2, 3, -5], [7, 2, 1, 9, 3]]).tobytes()
    found = spark.createDataFrame([(bytearray(packed),), (None,)], "rest binary")
    for rows in (500_000, 0):
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", rows)
        for keys, want in (([1, -5], [(-5, 3), (1, 2), (1, 7)]), ([4], []), ([], [])):
            wanted = spark.createDataFrame([(k,) for k in keys], "key long")
            assert sorted(map(tuple, linededup._unpacked(found, wanted).collect())) == want


def test_order_never_falls_as_the_id_rises(spark):
    for kind, ids in (("string", [None, "", "a", "a\0", "ab", "abcdefg", "abcdefgh", "b", "\u00e9", "\U0001f600"]), ("int", [None, -5, 0, 7]), ("double", [None, -1.0, 2.0])):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"n int, id {kind}")
        found = [r[0] for r in rows.orderBy("n").select(linededup._order(rows)).collect()]
        assert found == sorted(found) and (kind == "double" or len(set(found)) >= len(ids) - 2)


def test_long_sets_at_the_bound_meet(monkeypatch):
    words = [f"w{i}" for i in range(40_000)]
    rows = postings_of(monkeypatch, [" ".join(words[:36_000]), " ".join(words), " ".join(words[:30_000])], [1, 2, 3])
    rows = rows[:, np.lexsort((rows[4], rows[1], rows[2], rows[0]))]
    low, high, _ = linededup._candidates(rows)
    assert {tuple(sorted(p)) for p in zip(rows[4, low].tolist(), rows[4, high].tolist())} == {(1, 2), (1, 3)}
