"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins by the quantiles of the labelled rows.
Shallow trees on one feature at a time are boosted in turn, and what a feature's
trees add per bin is summed into its lookup table; then the pairs of features
that explain most of what is left get two-way tables the same way.  A score is
the sum of table entries at the bins of a text, through the logistic function.

Only ``MAX_FIT_ROWS`` labelled rows are learnt from, those with the smallest
hash of their id; scoring reads every text whole, in the tasks that scan it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

MAX_FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 150
PAIR_ROUNDS = 50
RATE = 0.1
RIDGE = 1.0
ACCEPT = 0.7

FEATURES = (
    "log_words", "word_length", "capital_share", "digit_share", "mark_share", "symbol_share",
    "shout_share", "bar_share", "space_share", "other_share", "distinct_words", "top_word_share",
    "repeat_share", "distinct_lines", "words_per_line", "words_per_sentence", "short_words", "long_words",
)

_CAPITALS = slice(65, 91)
_DIGITS = slice(48, 58)
_MARKS = [ord(c) for c in ".,;:?'\"()-"]
_SYMBOLS = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]
_SENTENCE_END = re.compile(rb"[.!?](?:\s|$)")


def features(text: str | None) -> np.ndarray:
    """What is measured of a whole text; zeros for an empty one."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, chars = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / chars
    lengths = np.fromiter(map(len, words), np.int64, n)
    different = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeats = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    return np.array(
        [
            np.log1p(n),
            lengths.mean(),
            counts[_CAPITALS].sum(),
            counts[_DIGITS].sum(),
            counts[_MARKS].sum(),
            counts[_SYMBOLS].sum(),
            counts[ord("!")],
            counts[ord("|")],
            counts[[9, 10, 32]].sum(),
            counts[128:].sum(),
            len(different) / n,
            max(different.values()) / n,
            repeats / n,
            len(set(lines)) / len(lines),
            n / len(lines),
            n / max(1, len(_SENTENCE_END.findall(data))),
            (lengths <= 3).mean(),
            (lengths > 12).mean(),
        ]
    )


@dataclass
class Model:
    """Lookup tables by feature and by pair of features."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    pair_cuts: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = binned(x, self.cuts), binned(x, self.pair_cuts)
        total = np.full(len(x), self.base)
        for j, entries in enumerate(self.tables):
            total += entries[bins[:, j]]
        for i, j, entries in self.pairs:
            total += entries[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values per bin of a shallow tree, from the sums of gradient and curvature per bin."""
    total_g, total_h = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(total_g - left_g, total_h - left_h)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(total_g, total_h) + 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), total_g / (total_h + RIDGE))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of the first feature with a cut of the second on each side."""
    best, values = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        parts = [_tree(g[s].sum(0), h[s].sum(0), 1) for s in (slice(None, cut), slice(cut, None))]
        grid = np.concatenate([np.tile(parts[0], (cut, 1)), np.tile(parts[1], (len(g) - cut, 1))])
        gain = float((2 * grid * g - grid * grid * (h + RIDGE / g.size)).sum())
        if gain > best:
            best, values = gain, grid
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the strongest pairs."""
    if not len(x):
        # nothing is known against any text
        return Model(30.0, [np.array([])] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], [np.array([])] * len(FEATURES))
    cuts, pair_cuts = quantile_cuts(x, BINS), quantile_cuts(x, PAIR_BINS)
    bins, coarse = binned(x, cuts), binned(x, pair_cuts)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))), cuts, [np.zeros(len(c) + 1) for c in cuts], [], pair_cuts)
    total = np.full(len(y), model.base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j, entries in enumerate(model.tables):
            step = RATE * np.clip(_tree(*sums(bins[:, j], len(entries)), 2), -4, 4)
            entries += step
            total += step[bins[:, j]]

    sizes = [len(c) + 1 for c in pair_cuts]

    def pair_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = sums(coarse[:, i] * sizes[j] + coarse[:, j], sizes[i] * sizes[j])
        return g.reshape(sizes[i], sizes[j]), h.reshape(sizes[i], sizes[j])

    couples = [(i, j) for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
    strongest = sorted(couples, key=lambda c: -_pair_tree(*pair_sums(*c))[0])[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in strongest]
    for _ in range(PAIR_ROUNDS):
        for i, j, entries in model.pairs:
            step = RATE * np.clip(_pair_tree(*pair_sums(i, j))[1], -4, 4)
            entries += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_FIT_ROWS,
) -> Model:
    """Fit on at most ``max_rows`` labelled documents outside the held-out part.

    Null ids and labels are left out; of several labels of an id the lowest
    counts, of several documents of an id one.  Without labels every text
    scores near 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    chosen = (
        known.groupBy(F.col(id_col).alias("key"))
        .agg(F.min(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    # at most max_rows pairs of two numbers are broadcast
    rows = (
        texts.join(F.broadcast(chosen), "key")
        .select("key", "label", _features("text").alias("x"))
        .groupBy("key")
        .agg(F.first("label").alias("y"), F.min("x").alias("x"))
        .orderBy("key")
        .toArrow()
    )
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy().astype(float))


@F.pandas_udf(ArrayType(DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(features)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """The documents with their score from 0 to 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(text) for text in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return docs.withColumn(into, scored(F.col(text_col)))
