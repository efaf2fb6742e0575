"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features: a shallow tree on one feature's
bins is fitted to what the model still has wrong, and added, shrunk, to that feature's lookup table;
then the same for the pairs of features whose joint bins explain most of the rest. A text is scored
by looking up its bins in all tables and adding them up, a whole batch at a time.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``); all texts are scored whole.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import batch, id_and_text, small_batches

#: Labelled rows that a model is fitted on at most; those with the smallest hashes of their ids.
SAMPLE = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 40, 8, 0.15
FEATURES = (
    "log_chars", "log_words", "mean_word", "distinct_words", "same_as_last", "top_word", "distinct_pairs", "upper",
    "digit", "symbol", "exclaim", "bar", "stop", "comma", "line_ends", "same_lines", "capital_words", "short_words",
    "longest_word", "double_marks",
)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,"]] = True


def features(text: str) -> list[float]:
    """The ``FEATURES`` of a whole text; all zero for an empty one."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    words = text.split()
    n = max(1, len(words))
    kinds = Counter(words)
    lines = text.split("\n")
    pairs = len(set(zip(words, islice(words, 1, None))))
    lengths = list(map(len, words))
    return [
        np.log1p(size), np.log1p(len(words)), sum(lengths) / n, len(kinds) / n,
        sum(map(operator.eq, words, islice(words, 1, None))) / n, max(kinds.values(), default=0) / n, pairs / n,
        counts[65:91].sum() / size, counts[48:58].sum() / size, counts[_IS_SYMBOL].sum() / size, counts[33] / size,
        counts[124] / size, counts[46] / size, counts[44] / size, counts[10] / size, 1 - len(set(lines)) / len(lines),
        sum(map(str.istitle, words)) / n, sum(map((4).__gt__, lengths)) / n, np.log1p(max(lengths, default=0)),
        sum(raw.count(c) for c in (b"!!", b"%%", b"$$", b"##", b"&&", b"**")) / n,
    ]


@dataclass
class Model:
    """Bin edges and a lookup table per feature, and a table per pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row of features."""
        found = self.bins(x)
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[found[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[found[:, i], found[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree on ordered bins: values per bin, from sums of gradients and curvatures per bin."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), leaf(g.sum(), h.sum()))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    at = int(np.argmax(left_g * leaf(left_g, left_h) + right_g * leaf(right_g, right_h))) + 1
    return np.concatenate([tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of one axis, then of the other in each half: values per cell, and the gain."""
    best: tuple[np.ndarray, float] | None = None
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        cg, ch = np.cumsum(np.cumsum(gg, axis=0), axis=1), np.cumsum(np.cumsum(hh, axis=0), axis=1)
        gain = np.zeros(len(gg) - 1)
        cuts = []
        for low_g, low_h in ((cg[:-1], ch[:-1]), (cg[-1] - cg[:-1], ch[-1] - ch[:-1])):  # rows before a cut, after it
            one_g, one_h = low_g[:, :-1], low_h[:, :-1]
            two_g, two_h = low_g[:, -1:] - one_g, low_h[:, -1:] - one_h
            gains = one_g * leaf(one_g, one_h) + two_g * leaf(two_g, two_h)
            where = gains.argmax(axis=1)
            rows = np.arange(len(where))
            gain += gains[rows, where]
            cuts.append((where + 1, leaf(one_g, one_h)[rows, where], leaf(two_g, two_h)[rows, where]))
        at = int(gain.argmax())
        if best is None or gain[at] > best[1]:
            values = np.empty_like(gg)
            for rows, (where, one, two) in ((slice(0, at + 1), cuts[0]), (slice(at + 1, None), cuts[1])):
                values[rows, :where[at]], values[rows, where[at]:] = one[at], two[at]
            best = (values.T if flip else values), float(gain[at])
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on features and labels 0/1. Without rows of both classes, all texts get one score."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.empty(0)
             for i in range(len(FEATURES))]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    found = model.bins(x)
    total = np.full(len(y), base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            g, h = residuals()
            step = RATE * tree(np.bincount(found[:, i], g, len(table)), np.bincount(found[:, i], h, len(table)))
            table += step
            total += step[found[:, i]]
    cells = {(i, j): found[:, i] * len(model.tables[j]) + found[:, j]
             for i, j in combinations(range(len(FEATURES)), 2) if len(edges[i]) and len(edges[j])}

    def fitted(i: int, j: int) -> tuple[np.ndarray, float]:
        g, h = residuals()
        shape = len(model.tables[i]), len(model.tables[j])
        sums = [np.bincount(cells[i, j], v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
        return pair_tree(*sums)

    gains = {pair: fitted(*pair)[1] for pair in cells}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = RATE * fitted(i, j)[0]
            table += step
            total += step[found[:, i], found[:, j]]
    return model


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(texts: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = SAMPLE) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` labelled rows that ``learn`` allows, picked by a hash of
    the id. Several labels of one id count by the smallest; rows without id or label are left out."""
    chosen = (labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(learn)
              .filter("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return texts.join(F.broadcast(chosen), "doc_id")  # ``most`` rows of 16 bytes


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE,
                  id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit the model on a sample of the labelled rows that ``learn`` (over the labels' columns) allows."""
    small_batches(docs.sparkSession)
    schema = "y double, x array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(schema, y=rows["y"], x=[features(t) for t in rows["text"].to_pylist()])

    sample = labelled_sample(id_and_text(docs, id_column, text_column), labels, "quality", learn, most)
    # As many numbers as ``most`` times the features, whatever the corpus; sorted, so that the fit is repeatable.
    rows = sorted((r["y"], *r["x"]) for r in sample.mapInArrow(work, schema).collect())
    found = np.array(rows).reshape(len(rows), len(FEATURES) + 1)
    return fit(found[:, 1:], found[:, 0])


def score_quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` for each row: 1 is best. A null text counts as empty; an empty text has a score.
    Repeated rows give equal results; other columns are not read."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = np.array([features(t) for t in rows["text"].to_pylist()]).reshape(-1, len(FEATURES))
            yield batch(schema, doc_id=rows["doc_id"], score=model.score(x))

    return id_and_text(docs, id_column, text_column).mapInArrow(work, schema)


def keep_good(docs: DataFrame, model: Model, least: float = 0.7, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(place).to_pylist()]
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield rows.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(work, docs.schema)
