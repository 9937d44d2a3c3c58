"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (words, and word shapes up to three in a row) are scaled by the
log ratio of their counts in the two classes. A linear hinge-loss model of these is fitted by
dual coordinate descent and mixed with the plain naive Bayes weights. A logistic curve,
fitted on a part of the sample that the weights did not see, turns margins into scores.

Fitting reads at most `per_class` labelled documents of each class; everything else runs over
all rows. Defined results: null and empty texts have no n-grams and get the score of margin
0; where one class has no labelled document, every score is the share of the other (0.5 where
there are no labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.llm.batches import Rolling, Words, arrow_map, fresh, mix, pick
from quantspan.llm.samples import labelled

BITS = 17


@dataclass(frozen=True)
class Settings:
    per_class: int = 3_000
    smoothing: float = 1.0
    cost: float = 1.0
    mixing: float = 0.25  # share of the fitted weights' deviation from their mean size
    epochs: int = 10
    calibration: int = 5  # every so-manieth document only calibrates
    seed: int = 11


def _classes() -> np.ndarray:
    """Class of each code point of the first plane: upper, lower, digit, other letter, or itself."""
    table = np.arange(1 << 16, dtype=np.uint64) + np.uint64(16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            table[i] = 1 if c.isupper() else 2 if c.islower() else 3
        elif c.isdigit():
            table[i] = 4
    return table


_table: list[np.ndarray] = []


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every different n-gram of each text, in order of text."""
    if not _table:
        _table.append(_classes())
    w = Words(texts)
    kind = _table[0][np.minimum(w.codes, 0xFFFF)]
    # Runs of one class count once; every word starts a run.
    run = np.ones(len(kind), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[w.starts] = True
    at = np.cumsum(run) - run
    shapes = Rolling(mix(kind[run]))(at[w.starts], at[w.ends]) if len(w.starts) else np.zeros(0, np.uint64)
    words = w.hashes()
    again = np.concatenate([[False], (words[1:] == words[:-1]) & (w.doc[1:] == w.doc[:-1])])[: len(words)]
    shapes = shapes ^ np.where(again, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0))
    rolling = Rolling(shapes)
    keys, docs = [mix(words), shapes], [w.doc, w.doc]
    for n in (2, 3):
        count = max(0, len(words) - n + 1)
        start = np.flatnonzero(w.doc[n - 1 :] == w.doc[:count]) if count else np.zeros(0, np.int64)
        keys.append(rolling(start, start + n))
        docs.append(w.doc[start])
    bucket = (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.sort((np.concatenate(docs).astype(np.int64) << BITS) | bucket)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both >> BITS, both & ((1 << BITS) - 1)


def _indicators(texts: list[str]) -> dict[str, pa.Array]:
    doc, feature = features(texts)
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    raw = feature.astype("<i4").tobytes()
    return {"features": pa.array([raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)], pa.binary())}


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, s: Settings) -> np.ndarray:
    """Weights of the hinge loss with a squared penalty, one dual coordinate at a time."""
    rng = np.random.default_rng(s.seed)
    w, dual = np.zeros(size), np.zeros(len(rows))
    square = np.array([v @ v for v in values])
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            if square[i] == 0:
                continue
            gradient = y[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), s.cost)
            if new != dual[i]:
                w[rows[i]] += (new - dual[i]) * y[i] * values[i]
                dual[i] = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with a small pull of the slope to 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin + 0.1 * (a - 1), g.sum() + 0.1 * b])
        hess = np.array([[h @ margin**2 + 0.1, h @ margin], [h @ margin, h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def score(self, texts: list[str]) -> np.ndarray:
        doc, feature = features(texts)
        margin = self.margin(doc, feature, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))

    def margin(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[feature]
        norm = np.sqrt(np.bincount(doc, weights=r * r, minlength=n))
        return np.bincount(doc, weights=r * self.weight[feature], minlength=n) / np.maximum(norm, 1e-12)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, counts: dict[int, int], s: Settings) -> Model:
    size = 1 << BITS
    total = max(sum(counts.values()), 1)
    if len(set(labels.tolist())) < 2:
        share = min(max(counts.get(1, 0) / total, 0.001), 0.999) if counts else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, float(np.log(share / (1 - share))))
    own = np.arange(len(rows)) % s.calibration != 0
    if len(set(labels[own].tolist())) < 2:
        own[:] = True
    there = {k: np.full(size, s.smoothing) for k in (0, 1)}
    for r, k in zip(rows, labels):
        there[k][r] += 1
    n = {k: (labels == k).sum() + 2 * s.smoothing for k in (0, 1)}
    ratio = np.log(there[1] / n[1]) - np.log(there[0] / n[0])
    if not own.all():
        counted = {k: np.full(size, s.smoothing) for k in (0, 1)}
        for i in np.flatnonzero(own):
            counted[labels[i]][rows[i]] += 1
        n = {k: (labels[own] == k).sum() + 2 * s.smoothing for k in (0, 1)}
        ratio = np.log(counted[1] / n[1]) - np.log(counted[0] / n[0])
    values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-12) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    pick_ = np.flatnonzero(own)
    w = descend([rows[i] for i in pick_], [values[i] for i in pick_], y[pick_], size, s)
    mean = np.abs(w).sum() / max(np.count_nonzero(w), 1)
    w = (1 - s.mixing) * mean + s.mixing * w
    model = Model(ratio, w, 1.0, 0.0)
    rest = np.flatnonzero(~own) if not own.all() else pick_
    margin = np.array([w[rows[i]] @ values[i] for i in rest])
    scale = max(np.abs(margin).std(), 1e-9)
    prior = np.array([counts[k] / max((labels[rest] == k).sum(), 1) for k in labels[rest]])
    a, b = logistic(margin / scale, (labels[rest] == 1).astype(float), prior * len(rest) / prior.sum())
    model.slope, model.offset = a / scale, b
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, s: Settings = Settings()) -> Model:
    sample, counts = labelled(docs, labels, label, modulus, held_out, s.per_class)
    got = arrow_map(sample, _indicators, "features binary").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in got["features"].to_pylist()]
    return fit_rows(rows, np.array(got["label"].to_pylist(), np.int64), counts, s)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """-> the other columns of `docs`, score double; a column named score is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights and ratios
    column = fresh(docs, "text_to_score")
    kept = {c: c for c in docs.columns if c != text and c.lower() != "score"}
    run = lambda texts: {"score": pa.array(shared.value.score(texts), pa.float64())}
    return arrow_map(pick(docs, **kept, **{column: text}), run, "score double", column)
