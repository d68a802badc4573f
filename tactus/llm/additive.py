"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features in turn; each step fits a shallow tree to one
feature's bins and adds it to that feature's lookup table. Then pairs of features are ranked by the gain of one 2x2
split on the residuals, and the best pairs get tables of their own, boosted in turn in the same way. A score is the
logistic of a sum of table entries: one vectorised gather and addition per table.

Features come from the whole text in one pass and are stored; no text is shuffled. The model is fitted on at most
`SAMPLE_ROWS` labelled rows (chosen by a hash of the id, so the same at every partitioning); the sample is the only thing
that reaches the driver.

Null texts count as empty; empty texts get the score of their bins. Null labels are not learned from. Repeated ids with
several labels contribute each. Without any label, or with one class only, the score is the smoothed share of that class.
Extra columns are kept by `keep_good` and not returned by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import as_bytes, lean, slices, stored, text_bytes

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 40_000
FEATURES = ("log_words", "word_length", "upper", "digits", "marks", "stops", "bars", "bangs", "brackets", "other_bytes",
            "lines", "repeats", "distinct", "line_copies", "glued", "longest_word")
MARKS, STOPS, BRACKETS = b"#$%&*@^~=+_\\/<>", b".,;:?", b"()[]{}\"'"


def features_of(raw: bytes) -> tuple[float, ...]:
    """Shares of byte classes, lengths and repetition of a text."""
    n = len(raw)
    if not n:
        return (0.0,) * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda chars: float(count[list(chars)].sum()) / n
    found = raw.split()
    m = max(1, len(found))
    lines = [x for x in raw.split(b"\n") if x]
    return (np.log1p(len(found)), n / m, float(count[65:91].sum()) / n, float(count[48:58].sum()) / n, share(MARKS), share(STOPS),
            share(b"|"), share(b"!"), share(BRACKETS), float(count[128:].sum()) / n, len(lines) / m, sum(map(eq, found, found[1:])) / m,
            len(set(found)) / m, 1 - len(set(lines)) / max(1, len(lines)), float(count[list(MARKS)].sum()) / m, max(map(len, found), default=0))


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.array([features_of(x) for x in raw], np.float32).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Bin edges and lookup tables."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "left")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.coarse)]
            for a, b, table in self.pairs:
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A tree over ordered bins with summed gradients g and curvatures h: the value of each bin."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl * gl / (hl + 1) + gr * gr / (hr + 1), -1.0)
        k = int(np.argmax(gain))
        if gain[k] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return np.concatenate((_tree(g[:k + 1], h[:k + 1], depth - 1, least), _tree(g[k + 1:], h[k + 1:], depth - 1, least)))
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quadrants: gain and the value of each cell."""
    ends = lambda m: np.cumsum(np.cumsum(m, 0), 1)
    G, H = ends(g), ends(h)
    best, out = 0.0, np.zeros_like(g)
    base = G[-1, -1] ** 2 / (H[-1, -1] + 1)
    for i in range(g.shape[0] - 1):
        gs = np.stack((G[i, :-1], G[i, -1] - G[i, :-1], G[-1, :-1] - G[i, :-1], G[-1, -1] - G[i, -1] - G[-1, :-1] + G[i, :-1]))
        hs = np.stack((H[i, :-1], H[i, -1] - H[i, :-1], H[-1, :-1] - H[i, :-1], H[-1, -1] - H[i, -1] - H[-1, :-1] + H[i, :-1]))
        gain = (gs * gs / (hs + 1)).sum(0) - base
        j = int(np.argmax(gain))
        if gain[j] > best:
            best, v = float(gain[j]), _leaf(gs[:, j], hs[:, j])
            out = np.block([[np.full((i + 1, j + 1), v[0]), np.full((i + 1, g.shape[1] - j - 1), v[1])],
                            [np.full((g.shape[0] - i - 1, j + 1), v[2]), np.full((g.shape[0] - i - 1, g.shape[1] - j - 1), v[3])]])
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, depth: int = 2, bins: int = 64, grid: int = 8,
        pairs: int = 8, pair_rounds: int = 30) -> Model:
    """Cyclic boosting on the logistic loss."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(intercept=float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    quantiles = lambda n, v: np.unique(np.quantile(v, np.arange(1, n) / n, method="lower"))
    k = x.shape[1]
    model.edges = [quantiles(bins, x[:, j]) for j in range(k)]
    model.coarse = [quantiles(grid, x[:, j]) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(model.coarse)]
    total = np.full(len(y), model.intercept)
    slopes = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-total)))
    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n), depth, 1e-3 * len(y) ** 0.5)
            model.tables[j] += step
            total += step[binned[j]]
    cell = {}
    g, h = slopes()
    for a in range(k):
        for b in range(a + 1, k):
            shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
            at = coarse[a] * shape[1] + coarse[b]
            gain, _ = _quadrants(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))
            cell[a, b] = (gain, at, shape)
    chosen = sorted(cell, key=lambda ab: (-cell[ab][0], ab))[:pairs]
    tables = {ab: np.zeros(cell[ab][2]) for ab in chosen}
    for _ in range(pair_rounds):
        for ab in chosen:
            g, h = slopes()
            _, at, shape = cell[ab]
            _, step = _quadrants(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))
            tables[ab] += rate * step
            total += rate * step.reshape(-1)[at]
    model.pairs = [(a, b, tables[a, b]) for a, b in chosen]
    return model


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bounded_labels(labels: DataFrame, label: str, bound: int, modulus: int, held_out: int) -> DataFrame:
    """At most about `bound` (doc_id, y) rows to learn from, chosen by a hash of the id."""
    rows = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(
        F.col("y").isNotNull() & (id_remainder("doc_id", modulus) != held_out))
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return rows


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and an array of features of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                x = _matrix(as_bytes(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "features"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes(text_col).alias("raw")).mapInArrow(lean(run), f"doc_id {id_type}, features array<float>")


def train(found: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int = SAMPLE_ROWS) -> Model:
    """Fits a model on stored features and a bounded sample of labels."""
    rows = found.join(bounded_labels(labels, label, bound, modulus, held_out), "doc_id").select("features", "y").toPandas()
    x = np.array(rows["features"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(float))


def score(found: DataFrame, model: Model) -> DataFrame:
    """doc_id and score from stored features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "features").mapInArrow(lean(run), f"doc_id {id_type}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with a score of at least the threshold, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(model.score(_matrix(as_bytes(part.column(at)))) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1) -> tuple[Model, DataFrame]:
    """The model and the stored features of all documents."""
    found = stored(features(docs), "features")
    return train(found, labels, label, modulus, held_out), found
