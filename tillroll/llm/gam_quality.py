"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives ``FEATURES`` numbers. Each is cut into at most ``BINS`` bins at quantiles of the fitting sample. Cyclic boosting then visits
the features in turn: a tree of at most two levels over one feature's bins is fitted to the logistic loss and added, damped, to that feature's lookup
table. Afterwards the pairs whose joint bins explain most of the rest get two-way tables in the same way. A score is the logistic function of
the intercept plus one table entry per feature and pair, added for a whole batch at once.

The model is fitted on a bounded sample of labelled rows (``sample``), whose features (not texts) come to the driver.
Empty and null texts have zero in every feature and are scored like any other. With labels of one kind only, the score is that label's share (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tillroll.llm.common import arrow_rows, labelled_sample, words_of

FEATURES = ["words", "word_length", "short_words", "distinct_words", "distinct_neighbours", "symbols", "bars", "shouts", "capitals", "digits", "sentence_ends", "commas", "line_words", "lines_ended", "repeated_lines", "symbol_words", "longest_run"]
BINS = 24


def features(text: str) -> list[float]:
    """The numbers of one text, from all of it; most are shares, so that length alone does not move them."""
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    chars = len(text)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    letters = int(count[65:91].sum() + count[97:123].sum())
    symbols = int(sum(count[ord(c)] for c in "#*$%&|<>"))
    tailed = sum(1 for w in words if w[-1] in "#*$%&|<>!")
    ends = int(count[33] + count[46] + count[63])
    return [np.log1p(n), sum(map(len, words)) / n, sum(1 for w in words if len(w) <= 3) / n, distinct / n, pairs, symbols / chars, int(count[124]) / n, int(count[33]) / n,
            int(count[65:91].sum()) / max(1, letters), int(count[48:58].sum()) / chars, ends / n, int(count[44]) / n, np.log1p(n / len(lines)),
            sum(1 for x in lines if x.rstrip()[-1:] in ".!?") / len(lines), 1 - len(set(lines)) / len(lines), tailed / n, np.log1p(max(map(len, words)))]


@dataclass
class Gam:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, levels: int = 2) -> np.ndarray:
    """Value of every bin in a tree of ``levels`` cuts, fitted to gradient and curvature sums by bin."""
    gain, at = _split(g, h) if levels else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:at], h[:at], levels - 1), shallow_tree(g[at:], h[at:], levels - 1)])


def shallow_tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut along an axis and one cut along the other in each half: gain and values."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            total, halves = 0.0, []
            for s in (slice(None, at), slice(at, None)):
                u, v = a[s].sum(0), b[s].sum(0)
                gain, cut = _split(u, v)
                total += gain + u.sum() ** 2 / (v.sum() + 1)
                row = np.concatenate([np.full(cut, _leaf(u[:cut].sum(), v[:cut].sum())), np.full(len(u) - cut, _leaf(u[cut:].sum(), v[cut:].sum()))])
                halves.append(np.repeat(row[None], len(a[s]), 0))
            if total > best[0]:
                out = np.concatenate(halves)
                best = (total, out.T if turn else out)
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 5, pair_rounds: int = 15) -> Gam:
    """Fits the tables to features ``x`` and 0/1 labels ``y``."""
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return Gam([np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(y.mean() / (1 - y.mean()))))
    b = model.bins(x)
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            step = rate * shallow_tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)))
            t += step
            z += step[b[:, j]]
    def sums(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        cell = b[:, i] * shape[1] + b[:, j]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
    p = 1 / (1 + np.exp(-z))
    ranked = sorted(((shallow_tree_2d(*sums(i, j, p))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:n_pairs]
    model.pairs = [(i, j) for _, i, j in ranked]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-z))
            step = rate * shallow_tree_2d(*sums(i, j, p))[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def featured(docs: DataFrame, keep: str = "doc_id bigint") -> DataFrame:
    """The columns of ``keep`` and ``x``, the features of text, for every row."""
    names = [c.strip().split(" ")[0] for c in keep.split(",")]
    return arrow_rows(docs.select(*names, "text"), lambda batch: {**{n: batch.column(n) for n in names}, "x": pa.array([features(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))}, f"{keep}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = 20_000) -> Gam:
    rows = featured(labelled_sample(docs, labels, label, learn, sample), "doc_id bigint, label int").collect()
    rows.sort()
    return boost(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["label"] != 0) for r in rows]))


def scored(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> dict:
        x = np.array([features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
        return {"doc_id": batch.column("doc_id"), "score": pa.array(shared.value.score(x), pa.float64())}

    return arrow_rows(docs.select("doc_id", "text"), one, "doc_id bigint, score double")
