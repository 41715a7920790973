"""Packing by power-of-two decomposition.

Each document is tokenized, closed with an end id and cut into pieces whose
lengths are powers of two: as many of the longest length as fit, then the
binary digits of the rest from high to low.  A piece is a sequence of its own,
so none crosses documents and none is padded.  Pieces of one length form a
bucket, from which equally long sequences are batched.

No shuffle: a document's pieces depend on that document only.  A task holds one
Arrow batch of texts and sends pieces on every few megabytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.alignment import ranked_bpe
from tidemark.llm.common import give_back, kept

#: Token ids of so many different words are remembered by a Python worker.
CACHE_WORDS = 200_000
FLUSH_BYTES = 8 << 20

# A space with white space on both sides: only there do tokens depend on more than one word.
_RUN = re.compile(r"\s (?!\S)")
# Words that every version of the character tables cuts alike: ASCII and Latin letters and marks, line ends only inside.
_PLAIN = re.compile(r"(?!\n)[\n\x21-\x7E\xA1-\u024F]+(?<!\n)")
#: Words that are encoded as one text.
RUN = 4096
# not ' and <, which begin contractions and special tokens
_MARKS = "!\"#$%&()*+,-./:;=?@[]^_{|}~"
GROUP = 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never merges across the end of a word, so a text is the
    sequence of its words, each with the space before it, and words are
    encoded once, plain ones many in a call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._added = re.compile("|".join(re.escape(token.content) for token in added) or r"(?!)")
        self._ranked, self._sizes = ranked_bpe(path)
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, known: dict[str, bytes], words: set[str], before: str) -> None:
        new = [word for word in words if word not in known]
        if before and self._ranked:
            plain = [word for word in new if _PLAIN.fullmatch(word)]
            if self._added.search(" ".join(plain)):
                plain = [word for word in plain if not self._added.search(word)]
            for low in range(0, len(plain), RUN):
                known.update(self._encode_run(plain[low : low + RUN], before))
            new = [word for word in new if word not in known]
        # letters and the marks after them are never merged, so each is encoded once
        ends = {}
        for word in new:
            stem = word.rstrip(_MARKS)
            if len(stem) < len(word) and stem.isalpha():
                ends[word] = stem, word[len(stem) :]
        whole = {word for word in new if word not in ends} | {x for x, _ in ends.values() if x not in known}
        self._add(known, whole, before)
        marks = {mark for _, mark in ends.values()} - self._marks.keys()
        self._add(self._marks, marks, "")
        known.update((word, known[stem] + self._marks[mark]) for word, (stem, mark) in ends.items())

    def _encode_run(self, words: list[str], before: str) -> Iterator[tuple[str, bytes]]:
        """The words with their ids, encoded as one text; those at whose end no token ends are left out."""
        ids = np.array(self._ranked.encode_ordinary(before + before.join(words)), "<u4")
        ends = np.cumsum(self._sizes[ids])
        wanted = np.cumsum([len(word.encode()) for word in words]) + len(before) * np.arange(1, len(words) + 1)
        upto = np.searchsorted(ends, wanted, side="right")
        good = ends[np.maximum(upto, 1) - 1] == wanted
        good[1:] &= good[:-1].copy()
        data, cuts = ids.tobytes(), [0, *(4 * upto).tolist()]
        found = zip(words, [data[i:j] for i, j in zip(cuts, cuts[1:])])
        return found if good.all() else compress(found, good)

    def _add(self, known: dict[str, bytes], words: set[str], before: str) -> None:
        if words:
            order = list(words)
            known.update(zip(order, self._encode([before + word for word in order])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._first) + len(self._later) > CACHE_WORDS:
            self._first.clear()
            self._later.clear()
            self._marks.clear()
        split = [None if _RUN.search(text) else text.split(" ") for text in texts]
        self._learn(self._first, {parts[0] for parts in split if parts}, "")
        self._learn(self._later, {word for parts in split if parts for word in parts[1:]}, " ")
        first, later = self._first, self._later
        return [
            self._encode([text])[0]
            if parts is None
            else first[parts[0]] + b"".join([later[word] for word in parts[1:]])
            for text, parts in zip(texts, split)
        ]


def encoder(path: str) -> Encoder:
    return kept(f"tokenizer {path}", lambda: Encoder(path))


def pieces(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; longest is a power of two."""
    cut = [(i * longest, longest) for i in range(tokens // longest)]
    start, rest = tokens // longest * longest, tokens % longest
    while rest:
        length = 1 << (rest.bit_length() - 1)
        cut.append((start, length))
        start, rest = start + length, rest - length
    return cut


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    longest: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece.

    Columns: the document's id, start (its ids before the piece), length, ids
    (binary, little-endian unsigned 32-bit), doc_tokens, bucket (log2 of the
    length), sequence_id and offset (0).  Sequence ids are unique and sort by
    bucket.  A null text counts as empty and gives the end id alone; repeated
    rows are packed each; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            owner: list[int] = []
            held = 0

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner)), *columns], names=["key", *schema.names]
                )

            for low in range(0, len(texts), GROUP):
                part = [text or "" for text in texts.slice(low, GROUP).to_pylist()]
                for i, ids in enumerate(encode(part), low):
                    ids += end
                    tokens = len(ids) // 4
                    for start, length in pieces(tokens, longest):
                        rows.append((start, length, ids[4 * start : 4 * (start + length)], tokens))
                        owner.append(i)
                    held += len(ids)
                if held > FLUSH_BYTES:
                    yield flush()
                    rows, owner, held = [], [], 0
                    give_back()
            if rows:
                yield flush()
            rows, owner = [], []
            give_back()

    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    cut_up = source.mapInArrow(cut, f"key {kind}, start long, length long, ids binary, doc_tokens long")
    bucket = F.length(F.bin("length")) - 1
    # 25 bits of task and 33 of row stay below the bucket
    number = F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id()
    return (
        cut_up.withColumn("bucket", bucket)
        .withColumn("sequence_id", number)
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumnRenamed("key", id_col)
    )
