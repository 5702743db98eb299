"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes FEATURES numbers, taken from its bytes and words over its whole length. Each feature is cut into at
most BINS bins at quantiles of the training rows. Cyclic boosting visits the features in turn; a visit fits one shallow
tree (up to three leaves) to the logistic gradient over the feature's bins and adds it, shrunk, to that feature's lookup
table. The strongest pairs, by the gain of a coarse grid over what the single features leave, are boosted in the same
way with trees of two levels. A score is the logistic of the intercept plus one entry of each table, looked up for a
whole batch at once.

The model is fitted on a bounded sample of labelled rows, the sample_rows with the least hash of their id, gathered as a
matrix of numbers on the driver; all else covers every row.

Defined cases: null text is empty text; empty texts are scored by their bins like any other; labels that are null or
whose document is missing are passed over; of repeated ids one row of features counts, the least; without labels, or
with only one kind, the score is the smoothed share of label 1; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import map_text, raw
from tessella.llm._tokens import LOWER, word_hashes, words

FEATURES = ("words", "word_bytes", "upper", "digit", "symbol", "dot_comma", "bare", "symbol_end", "twice", "distinct", "top", "short", "line_words", "long_word")
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS = 32, 120, 0.15, 6, 8


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


UPPER, DIGIT = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("0123456789")
LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(256)], np.int64)
SYMBOL = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,;:'\"-?()" for i in range(256)], np.int64)
DOT_COMMA, LINE = _marks(".,"), _marks("\n")


def features_of(column: pa.Array) -> np.ndarray:
    """A matrix of one row a text: shares of bytes and words, all finite, zero where there is nothing to share."""
    data, offsets = raw(column)
    starts, ends, bounds = words(data, offsets)
    n = np.diff(bounds)
    some, size = np.maximum(n, 1), ends - starts

    def bytes_of(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.concatenate([[0], np.cumsum(mark[data])])
        return total, total[offsets[1:]] - total[offsets[:-1]]

    def words_of(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[bounds[1:]] - total[bounds[:-1]]

    letters_upto, letters = bytes_of(LETTER)
    some_letters, solid = np.maximum(letters, 1), np.maximum(words_of(size), 1)
    hashes = word_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    run, owner = np.diff(np.append(edge, len(keys))), (keys[edge] >> np.uint64(40)).astype(np.int64)
    distinct, top = np.bincount(owner, minlength=len(n)), np.zeros(len(n), np.int64)
    np.maximum.at(top, owner, run)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, doc, size)
    lines = bytes_of(LINE)[1] + 1
    return np.column_stack([
        np.log1p(n), words_of(size) / some, bytes_of(UPPER)[1] / some_letters, bytes_of(DIGIT)[1] / solid, bytes_of(SYMBOL)[1] / solid, bytes_of(DOT_COMMA)[1] / some,
        words_of(letters_upto[ends] == letters_upto[starts]) / some, words_of(SYMBOL[data[ends - 1]]) / some if len(ends) else np.zeros(len(n)), words_of(same) / some, distinct / some, top / some,
        words_of(size <= 3) / some, np.log1p(n / lines), np.log1p(longest),
    ]).astype(np.float64)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place (bins before it) of the best cut of a run of bins by gradient and curvature sums."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _stump(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values a bin of a tree of up to so many leaves, grown where the gain is largest."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        gain, cut, (a, b) = max((*_best_cut(g[a:b], h[a:b]), (a, b)) for a, b in runs)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree of two levels over a grid: a cut of one side, then one of the other on each part."""
    best = (0.0, np.zeros(g.shape))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, a.shape[0]):
            out, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + 1)
            for rows in (slice(0, cut), slice(cut, None)):
                x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
                _, at = _best_cut(x, y)
                for cols in (slice(0, at), slice(at, None)):
                    s, t = x[cols].sum(), y[cols].sum()
                    gain += s * s / (t + 1)
                    out[rows, cols] = s / (t + 1)
            if gain > best[0] + 1e-9:
                best = (float(gain), out.T if turn else out)
    return best


@dataclass
class Model:
    """Cuts of each feature, its table, and tables of pairs over coarser bins."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)]
        for b, t in zip(bins, self.tables):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> Model:
    """Fits the model; the same rows in the same order give the same model."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    bins, total = [], np.full(len(y), model.intercept)
    for i in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1], method="higher"))
        cuts = cuts[cuts > x[:, i].min()]
        model.cuts.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.arange(len(cuts) + 1) * PAIR_BINS // (len(cuts) + 1))
        bins.append(np.searchsorted(cuts, x[:, i], side="right"))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(bins, model.tables):
            g, h = slopes()
            step = rate * _stump(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
            t += step
            total += step[b]
    g, h = slopes()
    cell = {}
    for i in range(x.shape[1]):
        for j in range(i):
            c = model.coarse[i][bins[i]] * PAIR_BINS + model.coarse[j][bins[j]]
            grid = [np.bincount(c, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)]
            cell[i, j] = _grid_tree(*grid)[0]
    for i, j in sorted(cell, key=lambda p: (-cell[p], p))[:pairs]:
        model.pairs.append((i, j, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(rounds // 4):
        for i, j, t in model.pairs:
            g, h = slopes()
            a, b = model.coarse[i][bins[i]], model.coarse[j][bins[j]]
            grid = [np.bincount(a * PAIR_BINS + b, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)]
            step = rate * _grid_tree(*grid)[1]
            t += step
            total += step[a, b]
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        x = features_of(batch.column(1))
        flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
        return {"id": batch.column(0), "x": flat}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000) -> Model:
    """Fits on at most sample_rows of the labels for which usable holds (a condition on id_col)."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    known = known if usable is None else known.where(usable)
    known = known.select(F.col(id_col).alias("own"), F.col(label).cast("int").alias("y")).groupBy("own").agg(F.max("y").alias("y"))
    # only hashes that can be among the least are ordered: else each task would send sample_rows rows to the driver
    share = (1.2 * sample_rows + 2000) / max(1, known.count())
    near = known if share >= 1 else known.where(F.xxhash64("own") <= F.lit(int(share * 2.0**64) - (1 << 63)))
    chosen = near.orderBy(F.xxhash64("own"), "own").limit(sample_rows)
    few = docs.join(F.broadcast(chosen), docs[id_col] == chosen.own).select(docs[id_col], docs[text_col])  # bounded by sample_rows
    x = features(few, id_col, text_col).groupBy("id").agg(F.min("x").alias("x"))
    rows = x.join(F.broadcast(chosen), x.id == chosen.own).select("id", "x", "y").toPandas().sort_values("id")
    if rows.empty:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(np.array(rows.x.tolist()), rows.y.to_numpy(np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns..., score) of every row, in one pass over the texts."""

    def run(batch: pa.RecordBatch) -> dict:
        got = {c: batch.column(c) for c in batch.schema.names if c != "text_"}
        return got | {"score_": pa.array(model.score(features_of(batch.column("text_"))))}

    held = [F.col(c) for c in dict.fromkeys([id_col, *keep])]
    from_ = docs.select(*held, F.col(text_col).cast("string").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_.schema if f.name != "text_")
    return map_text(from_, run, f"{schema}, score_ double", "text_").withColumnRenamed("score_", "score")
