"""Sharding and packing against their laws, with nulls, copies and hot rows."""

import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import common, packing, sharding
from tidemark.llm.queries import op1_histogram_sort, op2_packing

SF = "/root/testdata/sf0.001"


def check_shards(rows, shards, most_off):
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= most_off
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_query_is_balanced(spark):
    rows = op1_histogram_sort(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    check_shards(rows, 8, 2 * max(r.size for r in rows))


def test_hot_copies_and_repeated_rows_are_spread(docs, clashing):
    rows = [(7, "same text of a hot group", "s")] * 400 + [(i, "same text of a hot group", "s") for i in range(400)]
    rows += [(None, None, "s")] * 50 + [(i, f"text {i}", "s") for i in range(50)]
    found = sharding.shard(clashing(docs(*rows)), shards=4).collect()
    assert len(found) == len(rows)
    check_shards(found, 4, 60)
    assert {r.size for r in found if r.text is None} == {1}


def test_groups_stay_together_within_tolerance(docs):
    rows = [(i, f"text number {i // 2}", "s") for i in range(4000)]
    found = sharding.shard(docs(*rows), shards=4, tolerance=0.05).collect()
    home = {}
    for r in found:
        home.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_ranges_are_bounded():
    assert sharding.range_count(0, 8, 1 << 23) == 8
    assert sharding.range_count((1 << 26) + 1, 8, 1 << 23) == 16
    assert sharding.range_count(10**14, 8, sharding.RANGE_BYTES) == 65_536
    assert sharding.range_count(10**14, 1000, sharding.RANGE_BYTES) == 65_000
    assert sharding.range_count(10**14, 100_000, sharding.RANGE_BYTES) == 100_000


def test_few_ranges_keep_the_law(docs, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_RANGES", 12)
    found = sharding.shard(docs(*(f"text {i} " * (i % 40) for i in range(800))), 4, range_bytes=64).collect()
    assert len(found) == 800
    check_shards(found, 4, 2 * max(r.size for r in found))


def test_no_rows(docs):
    none = docs("x").limit(0)
    assert sharding.shard(none).collect() == []
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("low,high", [(0, 1 << 63), (5, 6), (5, 7), (1 << 23, 1 << 24), (0, (1 << 23) + 1)])
def test_probes_lie_inside(low, high):
    probes = sharding.probes_in(low, high, 8)
    assert all(low < p < high for p in probes) and len(set(probes)) == len(probes)
    assert probes or high - low == 1


def test_query_gives_back_every_token(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in op2_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(pieces) == len(docs)
    for doc in docs:
        ids = np.array([*whole.encode(doc.text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.length & (r.length - 1) == 0 and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    numbers = [r.sequence_id for rows in pieces.values() for r in rows]
    assert len(set(numbers)) == len(numbers)


def test_pack_edges(docs, clashing):
    long_text = "word, " * 40_000
    found = packing.pack(clashing(docs(None, "", "a  b\n c", long_text, long_text, (9, "a", "s"), (9, "a", "s")))).collect()
    assert [(r.length, r.ids) for r in found if r.doc_id == 0] == [(1, b"\x01\0\0\0")] == [
        (r.length, r.ids) for r in found if r.doc_id == 1
    ]
    assert sum(r.doc_id == 9 for r in found) == 2 * len({r.start for r in found if r.doc_id == 9})
    assert all(r.bucket == r.length.bit_length() - 1 for r in found)
    by_bucket = sorted(found, key=lambda r: r.sequence_id)
    assert [r.bucket for r in by_bucket] == sorted(r.bucket for r in found)
    with pytest.raises(ValueError):
        packing.pack(docs("a"), longest=100)


def test_words_are_encoded_as_in_the_text():
    rng = np.random.default_rng(1)
    bits = ["a", "B", "é", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "<|", "1", "..", "\xa0", ",", "ü!", "word.", "\r"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), packing.Encoder(path)
    for _ in range(1500):
        text = "".join(rng.choice(bits, rng.integers(0, 14)))
        assert own.encode([text])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_binary_pieces():
    assert packing.pieces(0, 8) == []
    assert packing.pieces(13, 8) == [(0, 8), (8, 4), (12, 1)]
    assert packing.pieces(16, 8) == [(0, 8), (8, 8)]


def test_plain_words_are_encoded_in_runs(monkeypatch):
    path = packing.default_tokenizer()
    tokenizer, encode = Tokenizer.from_file(path), packing.Encoder(path)
    alone = []
    monkeypatch.setattr(encode, "_encode", lambda texts, old=encode._encode: alone.extend(texts) or old(texts))
    words = [f"wörd{i}," for i in range(300)] + ["it's", "don'T", "a\nb", "a\n", "\tc", "x<|endoftext|>y", "\u4e2d\u6587", "", "\u017f", "1\u00bd"]
    texts = [" ".join(words), " ".join(reversed(words)), ""]
    for text, ids in zip(texts, encode.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not any(text.startswith(" wörd") for text in alone)


def test_packing_gives_freed_memory_back(monkeypatch):
    """After each part that is sent and at the end of each batch, so that a worker never piles up what it has freed."""
    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(packing, "FLUSH_BYTES", 0)
    batch = pa.record_batch([pa.array(range(300)), pa.array(["some text"] * 300)], ["key", "text"])

    class Source:
        schema = {"key": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            raise Found(list(run(iter([batch, batch]))))

    class Found(Exception):
        pass

    monkeypatch.setattr(packing.F, "col", lambda name: SimpleNamespace(alias=str))
    with pytest.raises(Found) as found:
        packing.pack(Source())
    assert sum(b.num_rows for b in found.value.args[0]) >= 600 and len(calls) == 2 * 3 + 2


def test_freed_memory_goes_back_to_the_system():
    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    # blocks of the C allocator below its threshold for mappings, with every hundredth of them still in use
    blocks = [np.ones(8_000) for _ in range(3_000)]
    some = blocks[::100]
    full = held()
    del blocks
    common.give_back()
    assert full - held() > 100 << 20 and len(some) == 30
