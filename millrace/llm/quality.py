"""Quality classifier: a generalised additive model with pairwise interactions.

Features are figures of a text: lengths, shares of kinds of characters, repetition, layout. Each
feature is cut into bins at quantiles of the sample. Cyclic boosting visits the features in
turn: a shallow tree over one feature's bins is fitted to the gradients and added, damped, to
that feature's lookup table. Then the pairs whose coarse grids explain most of what is left get
tables of their own in the same way. A score is the sum of one entry per table, through the
logistic function; scoring adds up bins for whole batches.

Bounded: the model is fitted on at most ``SAMPLE_ROWS`` labelled rows, drawn by a hash over all
of them; features of all rows are computed in the tasks. Only the text enters a score.

Defined cases: null and empty texts get the features of the empty text and a score like any
other. Labels that are null, or of ids that no document has, teach nothing; a document with
several labels teaches each. If all labels agree, or there are none, every score is the smoothed
share of label 1. Repeated documents are scored one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import remainder, table

SAMPLE_ROWS = 20_000
BINS = 48
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
RATE = 0.15
THRESHOLD = 0.3

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
_END = re.compile(r"[.!?](?=\s|$)")

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "uppers", "digits", "symbols", "pipes",
    "exclamations", "sentence_ends", "commas", "lines", "line_length", "short_lines", "repeated_lines",
    "distinct_words", "top_word", "repeated_words", "longest_run", "symbol_words", "upper_words", "short_words",
    "squeezed",
)


def text_features(text: str | None) -> list[float]:
    """One figure per name in ``FEATURES``; defined for every text."""
    text = text or ""
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    chars, n, m = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    raw = text.encode()
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        float(np.log1p(max(map(len, words), default=0))),
        len(_LETTER.findall(text)) / chars,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_SYMBOL.findall(text)) / chars,
        text.count("|") / n,
        text.count("!") / n,
        len(_END.findall(text)) / n,
        text.count(",") / n,
        float(np.log1p(len(lines))),
        float(np.log1p(len(text) / m)),
        sum(len(line) < 30 for line in lines) / m,
        1 - len(set(lines)) / m,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        float(np.log1p(max((len(list(g)) for _, g in groupby(words)), default=0))),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\")" for w in words) / n,
        sum(w.isupper() for w in words) / n,
        sum(len(w) <= 3 for w in words) / n,
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
    ]


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges, lookup tables of features and of pairs of features, and the base score."""

    base: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pair_edges: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def margins(self, features: np.ndarray) -> np.ndarray:
        """Log odds of label 1, one entry of every table added per row."""
        total = np.full(len(features), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, features[:, k], "right")]
        coarse = [np.searchsorted(e, features[:, k], "right") for k, e in enumerate(self.pair_edges)]
        for a, b, values in self.pairs:
            total += values[coarse[a], coarse[b]]
        return total

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(features), -40, 40)))


def _quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Best cut of a row of bins in two: gain, first bin of the right side (0 for no cut)."""
    left_g, left_h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    all_g, all_h = gradient.sum(), weight.sum()
    if not len(left_g):
        return 0.0, 0
    gains = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    at = int(np.argmax(gains))
    return (float(gains[at]), at + 1) if gains[at] > 1e-9 else (0.0, 0)


def _leaves(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree of the given depth over a row of bins."""
    _, at = _split(gradient, weight) if depth else (0.0, 0)
    if not at:
        return np.full(len(gradient), gradient.sum() / (weight.sum() + 1))
    halves = ((gradient[:at], weight[:at]), (gradient[at:], weight[at:]))
    return np.concatenate([_leaves(g, h, depth - 1) for g, h in halves])


def _grid_leaves(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The same over a grid: one cut along a side, one across in each half; with its gain."""
    best_gain, best = 0.0, np.zeros_like(gradient)
    for flip in (False, True):
        g, h = (gradient.T, weight.T) if flip else (gradient, weight)
        gain, at = _split(g.sum(1), h.sum(1))
        values = np.zeros_like(g)
        for rows in (slice(0, at), slice(at, None)):
            more, _ = _split(g[rows].sum(0), h[rows].sum(0))
            gain += more
            values[rows] = _leaves(g[rows].sum(0), h[rows].sum(0), 1)
        if gain > best_gain:
            best_gain, best = gain, values.T if flip else values
    return best_gain, best


def fit_additive(features: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of one table per feature, then of the most telling pairs."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return AdditiveModel(base, (), (), (), ())
    size = features.shape[1]
    edges = [_quantile_edges(features[:, k], BINS) for k in range(size)]
    bins = [np.searchsorted(e, features[:, k], "right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(labels), base)

    def state() -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-margin))
        return labels - chance, chance * (1 - chance)

    for _ in range(ROUNDS):
        for k in range(size):
            g, h = state()
            n = len(tables[k])
            step = RATE * _leaves(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n), 2)
            tables[k] += step
            margin += step[bins[k]]

    pair_edges = [_quantile_edges(features[:, k], PAIR_BINS) for k in range(size)]
    coarse = [np.searchsorted(e, features[:, k], "right") for k, e in enumerate(pair_edges)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = state()
    gains = {(a, b): _grid_leaves(grid(a, b, g), grid(a, b, h))[0] for a, b in combinations(range(size), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pairs = {p: np.zeros((len(pair_edges[p[0]]) + 1, len(pair_edges[p[1]]) + 1)) for p in chosen}
    for _ in range(ROUNDS):
        for (a, b), values in pairs.items():
            g, h = state()
            step = RATE * _grid_leaves(grid(a, b, g), grid(a, b, h))[1]
            values += step
            margin += step[coarse[a], coarse[b]]
    return AdditiveModel(
        base, tuple(edges), tuple(tables), tuple(pair_edges), tuple((a, b, v) for (a, b), v in pairs.items())
    )


def _featured(docs: DataFrame, others: list[str], text: str) -> DataFrame:
    """The columns ``others`` and features (array<double>) of every row."""
    picked = docs.select(*others, F.col(text).alias("__text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column("__text")]
            columns = [batch.column(n) for n in others] + [pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "features"])

    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in others)
    return picked.mapInArrow(compute, f"{kinds}, features array<double>")


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> AdditiveModel:
    """Model fitted on at most ``sample_rows`` of the labels for which ``usable`` holds.

    An id that several documents have teaches one of their texts, chosen by a hash.
    """
    known = labels.where(usable & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, label)
    drawn = known.orderBy(F.xxhash64(key, F.lit(3)), key, label).limit(sample_rows)
    sample = drawn.withColumnRenamed(label, "__label")
    # the sample is bounded by its parameter; documents are filtered where they lie
    taught = docs.select(key, text).join(F.broadcast(sample), key)
    taught = taught.groupBy(key, "__label").agg(F.min_by(text, F.xxhash64(text)).alias(text))
    rows = _featured(taught, ["__label", key], text).orderBy(key, "__label").collect()
    features = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_additive(features, np.array([r["__label"] for r in rows], float))


def score_quality(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key`` and score, one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x bins

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.array([text_features(t.as_py()) for t in batch.column(1)], float)
            found = shared.value.scores(features.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=[key, "score"])

    return docs.select(key, text).mapInArrow(score, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; a fifth of the rows, by crc32 of the id, is held out."""
    docs = table(spark, folder, "documents")
    fold = remainder(F.col("doc_id"), 5)
    model = fit_quality(docs, table(spark, folder, "labels"), fold != 0)
    return score_quality(docs, model).select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
