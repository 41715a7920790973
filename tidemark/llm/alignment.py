"""Alignment of two tokenizers by an associative fragment monoid.

Both tokenizers encode the same bytes.  Where a token of A and a token of B end
together a group closes; inside a group every pair of overlapping tokens is a
link.  A byte range of a text is a *fragment*: an open prefix up to its first
common end, closed groups, and an open suffix after its last one.  Composing two
neighbours closes the group that lies across their border:

    (p1, g1, s1) + (p2, g2, s2) = (p1, g1 + close(s1 + p2) + g2, s2)

and is associative, so a very long text is cut into byte ranges (at any byte,
also inside a token), its fragments are made in many tasks, and a tree of
groupings composes them.  Words of short texts are fragments whose ends are
known to be common, so they compose by appending; each is made once per task.

Counts of linked id pairs are taken over the whole corpus.  The ``hot_pairs``
most frequent ones are broadcast; rarer ones, if there are more, meet their
counts by a join, so the result is the same at any size.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, kept, staged

#: Longer texts are cut into byte ranges of this size.
CHUNK_BYTES = 1 << 16
#: Fragments that one task composes at a time.
FAN = 16
#: Pairs of ids whose counts are broadcast, 17 bytes each.
HOT_PAIRS = 4_000_000
#: What a task remembers of words, and what it holds before it sends rows on.
CACHE_BYTES, FLUSH_BYTES, GROUP = 84 << 20, 4 << 20, 256
#: What remembering a word takes beside its bytes, groups and links.
WORD_BYTES = 200
#: Words that are encoded and aligned as one text.
RUN = 4096

# A space opens a new unit if no white space stands before it and more than spaces follow: there
# both tokenizers begin a new token, whatever stands around.
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")
_SLOW = re.compile(r"\s | \Z")

#: Fixed value: how byte-level BPE cuts a text into words.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Open = tuple[list[int], list[int], list[int], list[int]]  # ids and ends of A, ids and ends of B


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    """Cut a text, which begins with a space, where both tokenizers can be cut."""
    if _SLOW.search(text, 1):
        return _CUT.split(text)
    return [" " + word for word in text[1:].split(" ")]


@dataclass
class Fragment:
    """The alignment of a byte range; ``tail`` is None if no common end lies in it."""

    head: Open = field(default_factory=lambda: ([], [], [], []))
    groups: list[str] = field(default_factory=list)  # runs of closed groups, each joined by ;
    pairs: list[np.ndarray] = field(default_factory=list)  # their links, run by run
    tail: Open | None = None


def fragment(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], size_b: int) -> Fragment:
    """The fragment of the tokens that end in a byte range; ends ascend."""
    common = sorted(set(a_ends).intersection(b_ends))
    if not common:
        return Fragment((a, a_ends, b, b_ends))
    i, j = a_ends.index(common[0]) + 1, b_ends.index(common[0]) + 1
    k, m = a_ends.index(common[-1]) + 1, b_ends.index(common[-1]) + 1
    head = a[:i], a_ends[:i], b[:j], b_ends[:j]
    inner = _run((a[i:k], a_ends[i:k], b[j:m], b_ends[j:m]), size_b)
    return Fragment(head, *inner, (a[k:], a_ends[k:], b[m:], b_ends[m:]))


def _run(x: Open, size_b: int) -> tuple[list[str], list[np.ndarray]]:
    groups, pairs = close(*x, size_b)
    return ([";".join(groups)], [np.array(pairs, np.int64)]) if groups else ([], [])


def close(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], size_b: int) -> tuple[list[str], list[int]]:
    """Groups and links of tokens that begin and end together.

    Each byte range between neighbouring ends lies in one token of either side,
    and no two lie in the same two, so the ranges are the links.
    """
    groups, pairs = [], []
    i = j = from_i = from_j = 0
    while i < len(a):
        pairs.append(a[i] * size_b + b[j])
        over = a_ends[i] - b_ends[j]
        i, j = i + (over <= 0), j + (over >= 0)
        if not over:
            groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
            from_i, from_j = i, j
    return groups, pairs


def compose(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """The fragment of two neighbouring byte ranges."""
    if x.tail is None:
        head = tuple(p + q for p, q in zip(x.head, y.head))
        return Fragment(head, y.groups, y.pairs, y.tail)
    across = tuple(p + q for p, q in zip(x.tail, y.head))
    if y.tail is None:
        return Fragment(x.head, x.groups, x.pairs, across)
    groups, pairs = _run(across, size_b)
    return Fragment(x.head, x.groups + groups + y.groups, x.pairs + pairs + y.pairs, y.tail)


def whole(x: Fragment, size_b: int) -> tuple[str, np.ndarray]:
    """Groups and links of a whole text, whose end is a common end."""
    groups, pairs = _run(x.head, size_b)
    return ";".join(groups + x.groups), np.concatenate([np.zeros(0, np.int64), *pairs, *x.pairs])


class Codec:
    """Both tokenizers, the bytes of their tokens, and the words met so far."""

    def __init__(self, a_path: str, b_path: str, with_groups: bool = True):
        """``with_groups``: whether the groups of words are wanted as text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = _token_bytes(self._a)
        self.b_bytes = [_piece_bytes(self._b, i) for i in range(self._b.get_piece_size())]
        self._ranked = _ranked(a_path, self.a_bytes)
        if self._ranked:
            self._a = None  # one copy of the vocabulary is enough
        self._a_size, self._b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        self.size_b = len(self.b_bytes)
        self._a_texts, self._b_texts = (pa.array(list(map(str, range(len(x))))) for x in (self.a_bytes, self.b_bytes))
        if any(b" " in piece.lstrip(b" ") for piece in self.b_bytes):
            raise ValueError(f"{b_path}: tokens go across words, so texts cannot be cut at spaces")
        self.begin(with_groups)

    def begin(self, with_groups: bool) -> None:
        """Know no words, and keep the groups of those to come or not."""
        self._with_groups = with_groups
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bad: set[str] = set()
        #: of each run of words: the groups of each word
        self.groups: list[pa.Array] = []
        #: of each run of words: their links, and per word n_a, n_b, n_groups, n_links
        self.pairs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B for a text that begins with a space; None if bytes get lost."""
        if self._ranked:
            a = self._ranked.encode_ordinary(text)
        else:
            a = self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b, raw = self._b.encode(text[1:]), text.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None

    def ends(self, a: list[int], b: list[int], start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return start + np.cumsum(self._a_size[a]), start + np.cumsum(self._b_size[b])

    def learn(self, words: set[str]) -> None:
        """Remember the closed fragments of words, aligned many at a time."""
        new = words.difference(self.known)
        new -= self.bad
        alone = [word for word in new if word[-1].isspace()]  # what follows white space depends on it
        rest = [word for word in new if not word[-1].isspace()]
        for run in (*(rest[k : k + RUN] for k in range(0, len(rest), RUN)), *([word] for word in alone)):
            if not self._learn(run):
                self.bad.update(word for word in run if not (len(run) > 1 and self._learn([word])))
        self.held += 100 * len(self.bad)

    def _learn(self, words: list[str]) -> bool:
        ids = self.encode("".join(words))
        if ids is None:
            return False
        a, b = map(np.array, ids)
        a_ends, b_ends = self.ends(a, b)
        ends = np.cumsum([len(word.encode()) for word in words])
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        again = np.append(both[1:] == both[:-1], False)
        links, common = both[~again], both[again]
        if not len(common) or (common[np.searchsorted(common, ends) % len(common)] != ends).any():
            return False
        pairs = a[np.searchsorted(a_ends, links)] * self.size_b + b[np.searchsorted(b_ends, links)]
        upto = [np.searchsorted(x, ends, side="right") for x in (a_ends, b_ends, common, links)]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        if self._with_groups:
            sides = (a, a_ends, self._a_texts), (b, b_ends, self._b_texts)
            sides = [_joined(texts.take(pa.array(x)), np.searchsorted(x_ends, common, side="right"), ",") for x, x_ends, texts in sides]
            self.groups.append(_joined(pc.binary_join_element_wise(*sides, "|"), upto[2], ";"))
            self.held += self.groups[-1].nbytes
        self.pairs.append(pairs)
        self.counts.append(np.diff(np.stack(upto, 1), axis=0, prepend=0).astype(np.int32))
        self.held += WORD_BYTES * len(words) + 8 * len(pairs) + int(ends[-1])
        return True

    def group_texts(self) -> pa.Array:
        """The groups of each known word."""
        self.groups = [pa.concat_arrays(self.groups)] if self.groups else [pa.array([], pa.string())]
        return self.groups[0]

    def texts(self, texts: list[str | None]) -> list[list[str] | None]:
        """The units of each text, all known; None for a text without tokens."""
        if self.held > CACHE_BYTES:
            self.forget()
        cut = [units(" " + text) if text else None for text in texts]
        self.learn(set().union(*filter(None, cut)))
        if not self.bad:
            return cut
        return [words if words and self.bad.isdisjoint(words) else None for words in cut]


    def places(self, cut: list[list[str] | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known words of some texts, one text after the other, and where each text's end."""
        cut = [words or () for words in cut]
        ends = np.cumsum(list(map(len, cut)))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, ends[-1]), ends


def _joined(texts: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """The texts up to each end joined; the ends ascend."""
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, texts), by)


def codec_of(paths: tuple[str, str], with_groups: bool = True) -> Codec:
    """The codec of this Python worker, knowing no words; its tokenizers are loaded once, not in every task."""
    codec = kept(f"codec {paths}", lambda: Codec(*paths))
    codec.begin(with_groups)
    return codec


def _ranked(path: str, tokens: list[bytes]):
    """The same tokenizer in a faster library, if its file is plain byte-level BPE: ids are merge ranks.

    None for any other file; ``tokenizers`` then encodes.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        and not spec["normalizer"] and not before["add_prefix_space"] and not model.get("ignore_merges")
    )
    merged = ["".join(x) if isinstance(x, list) else x.replace(" ", "", 1) for x in model.get("merges", ())]
    ids = [model["vocab"][x] for x in merged] if plain else []
    special = {x["id"] for x in spec["added_tokens"]}
    if not ids or ids != sorted(ids) or len(model["vocab"]) - len(special & set(model["vocab"].values())) != len(ids) + 256:
        return None
    ranks = {token: i for i, token in enumerate(tokens) if i not in special}
    return tiktoken.Encoding("plain", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def ranked_bpe(path: str):
    """(the faster encoder of a byte-level tokenizer or None, bytes of each of its tokens)"""
    from tokenizers import Tokenizer

    tokens = _token_bytes(Tokenizer.from_file(path))
    return _ranked(path, tokens), np.array(list(map(len, tokens)))


def _token_bytes(tokenizer) -> list[bytes]:
    letters = _byte_letters()
    return [
        bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token in map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))
    ]


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def align(
    docs: DataFrame,
    tokenizers: tuple[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    hot_pairs: int = HOT_PAIRS,
    fan: int = FAN,
) -> DataFrame:
    """One row per document.

    Columns: the document's id, n_a and n_b (tokens), n_groups, n_links, n_best
    (links whose pair is the most frequent of their B id in the corpus, ties
    included), count_sum (corpus counts over links) and groups (text
    ``a1,a2|b1;a3|b2``, ids in order).  Null and empty texts and texts that a
    tokenizer does not give back byte by byte have zeros and ''; they count for
    no pair.  Repeated rows are kept each; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    spark, paths = docs.sparkSession, tokenizers or default_tokenizers()
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short, long = source.where(size <= chunk_bytes), source.where(size > chunk_bytes)
    composed = _long_texts(long, paths, chunk_bytes, fan)
    counted = short.select("text").mapInArrow(_count_words(paths), "pair long, n long")
    if composed is not None:
        counted = counted.unionByName(composed.select("pairs").mapInArrow(_count_pairs, "pair long, n long"))
    size_b = Codec(*paths).size_b
    counts = staged(counted.groupBy("pair").agg(F.sum("n").alias("n")))
    best = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    ranked = staged(
        counts.join(best, F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    )
    total = ranked.count()
    hot = ranked if total <= hot_pairs else ranked.orderBy(F.desc("n"), "pair").limit(hot_pairs)
    sent = spark.sparkContext.broadcast(_lookup(hot))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, rare array<long>"
    found = short.mapInArrow(_score_words(paths, sent), schema)
    if composed is not None:
        found = found.unionByName(composed.mapInArrow(_score_pairs(sent), schema))
    if total > hot_pairs:
        found = _with_rare(found, ranked)
    return found.drop("rare").withColumnRenamed("key", id_col)


def _lookup(hot: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = hot.orderBy("pair").toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    return pair, n, best


def _with_rare(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add what the pairs beyond the broadcast count, by a join."""
    kept = staged(found.withColumn("_row", F.monotonically_increasing_id()))
    links = kept.select("_row", F.explode("rare").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("times"))
    added = links.join(ranked, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more"),
    )
    both = kept.join(added, "_row", "left")
    return both.select(
        "key", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups", "rare",
    )


def _aggregated(pairs: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(pairs)
    keys, first = np.unique(pairs[order], return_index=True)
    sums = np.add.reduceat(weights[order], first)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])


def _count_words(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, times = codec_of(paths, with_groups=False), np.zeros(0, np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            # some runs of words at a time, so that little is held beside them
            begun = 0
            for low in range(0, len(codec.pairs), 16):
                pairs, links = codec.pairs[low : low + 16], np.concatenate(codec.counts[low : low + 16])[:, 3]
                some, begun = times[begun : begun + len(links)], begun + len(links)
                yield _aggregated(np.concatenate(pairs), np.repeat(some, links))

        for batch in batches:
            texts = batch.column(0)
            for low in range(0, len(texts), GROUP):
                if codec.held > CACHE_BYTES:
                    yield from counted()
                    times = np.zeros(0, np.int64)
                at, _ = codec.places(codec.texts(texts.slice(low, GROUP).to_pylist()))
                seen = np.bincount(at, minlength=len(codec.known))
                seen[: len(times)] += times
                times = seen
        yield from counted()
        codec.forget()

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0):
            pairs = np.frombuffer(x.as_py(), np.int64)
            if len(pairs):
                yield _aggregated(pairs, np.ones(len(pairs), np.int64))


def _counts_of(sent, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each link whether it is its B id's best, and its count; 0 if it was not broadcast."""
    keys, n, best = sent
    if not len(keys):
        return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    there = keys[at] == pairs
    return best[at] & there, n[at] * there


class _Rows:
    """Result rows of a batch, sent on every few megabytes."""

    NAMES = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "rare"]

    def __init__(self, keys: pa.Array):
        self.keys, self.owner, self.rows, self.held = keys, [], [], 0

    def add(self, i: int, numbers: list[int], groups: str, rare: np.ndarray) -> None:
        self.owner.append(i)
        self.rows.append((numbers, groups, rare))
        self.held += len(groups) + 8 * len(rare)

    def batch(self) -> pa.RecordBatch:
        numbers = np.array([r[0] for r in self.rows], np.int64).reshape(len(self.rows), 6)
        columns = [pa.array(numbers[:, c]) for c in range(6)]
        texts = pa.array([r[1] for r in self.rows], pa.string())
        rare = pa.array([r[2] for r in self.rows], pa.list_(pa.int64()))
        out = pa.RecordBatch.from_arrays([self.keys.take(pa.array(self.owner, pa.int32())), *columns, texts, rare], names=self.NAMES)
        self.owner, self.rows, self.held = [], [], 0
        return out


def _score_words(paths: tuple[str, str], sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, lookup, none = codec_of(paths), sent.value, np.zeros(0, np.int64)
        numbers, runs, rare = np.zeros((0, 6), np.int64), 0, {}  # of the words that the codec knows
        for batch in batches:
            texts = batch.column(1)
            for low in range(0, len(texts), GROUP):
                cut = codec.texts(texts.slice(low, GROUP).to_pylist())
                if len(codec.known) < len(numbers) or len(codec.pairs) < runs:
                    numbers, runs, rare = np.zeros((0, 6), np.int64), 0, {}  # the codec has begun anew
                new = [numbers]
                for pairs, counts in zip(codec.pairs[runs:], codec.counts[runs:]):
                    best, n = _counts_of(lookup, pairs)
                    first = np.cumsum(counts[:, 3]) - counts[:, 3]
                    summed = [np.add.reduceat(x.astype(np.int64), first) for x in (best, n)]
                    owner = np.repeat(np.arange(len(counts)), counts[:, 3]) + sum(map(len, new))
                    for word, pair in zip(owner[n == 0].tolist(), pairs[n == 0].tolist()):
                        rare.setdefault(word, []).append(pair)
                    new.append(np.column_stack([counts, *summed]))
                numbers = np.concatenate(new)
                # what is summed is not needed again
                codec.pairs[runs:], codec.counts[runs:] = ([None] * (len(codec.pairs) - runs) for _ in range(2))
                runs = len(codec.pairs)
                # texts without tokens have no words, so their sums are zeros and their groups ''
                at, ends = codec.places(cut)
                # one number of all words at a time, as a group of long texts has many words
                sums = [np.diff(np.append(0, np.cumsum(column[at]))[ends], prepend=0) for column in numbers.T]
                groups = _joined(codec.group_texts().take(pa.array(at)), ends, ";")
                beyond = [none] * len(cut)
                if rare:
                    beyond = [[pair for word in some.tolist() for pair in rare.get(word, ())] for some in np.split(at, ends[:-1])]
                columns = [*map(pa.array, sums), groups, pa.array(beyond, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, GROUP), *columns], names=_Rows.NAMES)
        codec.forget()

    return run


def _score_pairs(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = sent.value
        for batch in batches:
            rows = _Rows(batch.column("key"))
            for i, x in enumerate(batch.select(["n_a", "n_b", "groups", "pairs"]).to_pylist()):
                pairs, groups = np.frombuffer(x["pairs"], np.int64), x["groups"]
                best, n = _counts_of(lookup, pairs)
                n_groups = groups.count(";") + 1 if groups else 0
                rows.add(i, [x["n_a"], x["n_b"], n_groups, len(pairs), best.sum(), n.sum()], groups, pairs[n == 0])
                if rows.held > FLUSH_BYTES:
                    yield rows.batch()
            if rows.rows:
                yield rows.batch()

    return run


OPEN = ["a", "a_ends", "b", "b_ends"]
FRAGMENT = [
    ("row", pa.int64()), ("chunk", pa.int64()), ("good", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    *((f"head_{x}", pa.list_(pa.int64())) for x in OPEN),
    ("groups", pa.string()), ("pairs", pa.binary()), ("ended", pa.bool_()),
    *((f"tail_{x}", pa.list_(pa.int64())) for x in OPEN),
]
_SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}
FRAGMENT_SQL = ", ".join(f"{name} {_SQL.get(kind, 'array<long>')}" for name, kind in FRAGMENT)
NO_TOKENS: Open = ([], [], [], [])


def _packed(row: int, chunk: int, good: bool, n_a: int, n_b: int, x: Fragment) -> pa.RecordBatch:
    """A fragment as a row; one that is not good has no tokens."""
    x, n_a, n_b = (x, n_a, n_b) if good else (Fragment(tail=NO_TOKENS), 0, 0)
    line = {
        "row": row, "chunk": chunk, "good": good, "n_a": n_a, "n_b": n_b,
        **{f"head_{k}": v for k, v in zip(OPEN, x.head)},
        "groups": ";".join(x.groups), "pairs": b"".join(p.tobytes() for p in x.pairs), "ended": x.tail is not None,
        **{f"tail_{k}": v for k, v in zip(OPEN, x.tail or NO_TOKENS)},
    }
    return pa.RecordBatch.from_pylist([line], schema=pa.schema(FRAGMENT))


def _unpacked(line: dict) -> Fragment:
    head, tail = (tuple(line[f"{part}_{x}"] for x in OPEN) for part in ("head", "tail"))
    groups = [line["groups"]] if line["groups"] else []
    return Fragment(head, groups, [np.frombuffer(line["pairs"], np.int64)], tail if line["ended"] else None)


def ranges(lengths: list[int], chunk_bytes: int) -> list[tuple[int, int, int, int]]:
    """(first unit, unit behind the last, first byte, byte behind the last) of each byte range.

    Borders are multiples of the size but for those inside a unit of more than
    one such size: it is one range, so no bytes are encoded many times.
    """
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    borders = np.arange(chunk_bytes, total, chunk_bytes)
    inside = np.searchsorted(ends, borders, side="left")
    borders = borders[np.asarray(lengths)[inside] <= chunk_bytes].tolist()
    lows, highs = [0, *borders], [*borders, total]
    first = np.searchsorted(ends, lows, side="right").tolist()
    last = np.searchsorted(ends, highs, side="left").tolist()
    return [(i, j + 1, low, high) for i, j, low, high in zip(first, last, lows, highs)]


def _cut_long(chunk_bytes: int):
    names = ["row", "chunk", "text", "start", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                words = units(" " + text.as_py())
                lengths = [len(word.encode()) for word in words]
                starts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                for chunk, (i, j, low, high) in enumerate(ranges(lengths, chunk_bytes)):
                    values = row.as_py(), chunk, "".join(words[i:j]), starts[i], low, high
                    yield pa.RecordBatch.from_pylist([dict(zip(names, values))])

    return run


def _fragments(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(paths)
        for batch in batches:
            for k in range(batch.num_rows):
                row, chunk, text, start, low, high = (batch.column(c)[k].as_py() for c in range(6))
                a: list[int] = []
                b: list[int] = []
                found = [codec.encode(word) for word in units(text)]
                good = all(ids is not None for ids in found)
                for ids in found if good else ():
                    a.extend(ids[0])
                    b.extend(ids[1])
                a_ends, b_ends = (x.tolist() for x in codec.ends(a, b, start))
                a, a_ends = _between(a, a_ends, low, high)
                b, b_ends = _between(b, b_ends, low, high)
                x = fragment(a, a_ends, b, b_ends, codec.size_b)
                yield _packed(row, chunk, good, len(a), len(b), x)

    return run


def _between(ids: list[int], ends: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    i, j = bisect_right(ends, low), bisect_right(ends, high)
    return ids[i:j], ends[i:j]


def _compose_neighbours(size_b: int, fan: int):
    def run(table: pa.Table) -> pa.Table:
        lines = sorted(table.to_pylist(), key=lambda line: line["chunk"])
        good = all(line["good"] for line in lines)
        x = reduce(lambda x, y: compose(x, y, size_b), map(_unpacked, lines)) if good else Fragment()
        n_a, n_b = (sum(line[name] for line in lines) for name in ("n_a", "n_b"))
        return pa.Table.from_batches([_packed(lines[0]["row"], lines[0]["chunk"] // fan, good, n_a, n_b, x)])

    return run


def _whole_texts(size_b: int):
    schema = pa.schema([("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                line = batch.slice(k, 1).to_pylist()[0]
                groups, pairs = whole(_unpacked(line), size_b)
                done = {"groups": groups, "pairs": pairs.tobytes()}
                yield pa.RecordBatch.from_pylist([{**{c: line[c] for c in ("row", "n_a", "n_b")}, **done}], schema=schema)

    return run


def _long_texts(long: DataFrame, paths: tuple[str, str], chunk_bytes: int, fan: int) -> DataFrame | None:
    """key, n_a, n_b, groups and pairs of long texts, by a tree of compositions; None without any."""
    kept = staged(long.withColumn("row", F.monotonically_increasing_id()))
    ends = F.max(F.octet_length("text")), F.count("*")
    longest, rows = kept.agg(*ends).first()
    if not rows:
        drop_staged(kept)
        return None
    size_b, width = Codec(*paths).size_b, -(-(longest + 1) // chunk_bytes)
    cut = kept.select("row", "text").mapInArrow(
        _cut_long(chunk_bytes), "row long, chunk long, text string, start long, low long, high long"
    )
    # byte ranges of one text go to many tasks
    level = cut.repartition("row", "chunk").mapInArrow(_fragments(paths), FRAGMENT_SQL)
    while width > 1:
        neighbours = level.groupBy("row", F.floor(F.col("chunk") / fan).alias("part"))
        level = neighbours.applyInArrow(_compose_neighbours(size_b, fan), FRAGMENT_SQL)
        width = -(-width // fan)
    done = level.mapInArrow(_whole_texts(size_b), "row long, n_a long, n_b long, groups string, pairs binary")
    return staged(done.join(kept.select("row", "key"), "row").drop("row"))
