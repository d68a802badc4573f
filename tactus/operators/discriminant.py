"""Linear discriminant classification from sums and cross-products, with cross-validation and permutation test.

Spark reduces the rows to one small block per class (count, sums) and one of cross-products. Models are solved from these
on the driver, sent to the tasks, and rows are scored in Arrow batches. A model has classes x (predictors + 1) numbers; at
most `MODEL_NUMBERS` are held at once.

In the permutation test no row is repeated: positions are permuted by a keyed bijection that any task can compute, holders
are numbered by class, so a permuted position tells its label. A block of rows gives the class sums of all permutations as
one matrix product of the one-hot labels and the predictors; the cross-products do not depend on the labels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions.numeric import draw
from tactus.layout import lay_out, plain, row_index
from tactus.session import settled

RIDGE = 1e-8
#: Numbers of all models that are in a task's memory at once; more permutations than that go in several passes.
MODEL_NUMBERS = 4_000_000
#: Rows scored at once, and entries of the one-hot matrix of a product.
ROWS, ONE_HOT = 2_048, 1 << 22


def _numbered(rows: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their class number `_y` and predictors `_x`; the classes (label, _y) in order; their number."""
    found = rows.filter(F.col(label).isNotNull()).select(F.col(label).alias("_label")).distinct().withColumn("_all", F.lit(0))
    classes = settled(row_index(found, "_all", "_label", "_y").select("_label", (F.col("_y") - 1).cast("int").alias("_y")))
    k = classes.count()
    if k * (len(features) + 1) > MODEL_NUMBERS:
        raise ValueError(f"a model of {k} classes has more than {MODEL_NUMBERS} numbers")
    data = rows.join(classes, F.col(label) == F.col("_label")).drop("_label")
    return data.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features])), classes, k


@dataclass
class Model:
    """Class counts and means, inverse pooled covariance, its divisor and log priors."""

    counts: np.ndarray
    means: np.ndarray
    inv: np.ndarray
    dof: float
    logp: np.ndarray


def _solve(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, prior: str) -> Model:
    d = sums.shape[1]
    means = sums / np.maximum(counts, 1)[:, None]
    scatter = products - (means * counts[:, None]).T @ means
    dof = counts.sum() - len(counts)
    dof = max(dof, 1.0) if dof > 0 else 1.0
    share = np.full(len(counts), 1.0 / len(counts)) if prior == "equal" else counts / max(counts.sum(), 1.0)
    return Model(counts, means, np.linalg.pinv(scatter / dof + RIDGE * np.eye(d)), dof, np.log(share + 1e-12))


def _predicted(m: Model, x: np.ndarray, y: np.ndarray, *, leave_one_out: bool, equal: bool) -> np.ndarray:
    """Class of each row; with leave_one_out by the model without the row (rank-one update)."""
    if not leave_one_out:
        proj = m.means @ m.inv
        return (x @ proj.T - 0.5 * (proj * m.means).sum(1) + m.logp).argmax(1)
    n, at = m.counts[y], np.arange(len(x))
    v = x - m.means[y]
    own = np.where((n > 1)[:, None], m.means[y] - v / np.maximum(n - 1, 1)[:, None], 0.0)
    rest = max(m.dof - 1, 1.0)
    # The divisor shrinks by one; the ridge is negligible against that rescaling.
    inv = m.inv * (rest / m.dof)
    w = np.where(n > 1, n / np.maximum(n - 1, 1), 0.0) / rest
    iv = v @ inv
    c = w / (1 - w * (v * iv).sum(1))
    # the inverse without the row is inv + c iv iv'
    along_x, proj = (x * iv).sum(1), m.means @ inv
    along = m.means @ iv.T
    s = x @ proj.T + (c * along_x)[:, None] * along.T - 0.5 * ((proj * m.means).sum(1)[None, :] + c[:, None] * along.T ** 2)
    o = (own * iv).sum(1)
    s[at, y] = ((x - 0.5 * own) * (own @ inv)).sum(1) + c * (along_x - 0.5 * o) * o
    if equal:
        return (s + m.logp).argmax(1)
    left = np.repeat(m.counts[None, :], len(x), 0)
    left[at, y] -= 1
    return (s + np.log(left / np.maximum(left.sum(1, keepdims=True), 1) + 1e-12)).argmax(1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(rows: DataFrame, key: str, k: int, d: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(counts, sums, products) of each key: a row per key and class and one per key come to the driver."""
    x = lambda i: F.element_at("_x", i + 1)
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for r in rows.groupBy(key, "_y").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x(i)) for i in range(d)]).alias("s")).toLocalIterator():
        counts, sums, _ = out.setdefault(r[key], (np.zeros(k), np.zeros((k, d)), np.zeros((d, d))))
        counts[r["_y"]], sums[r["_y"]] = r["n"], r["s"]
    for r in rows.groupBy(key).agg(F.array(*[F.sum(x(i) * x(j)) for i in range(d) for j in range(d)]).alias("p")).collect():
        out[r[key]][2][:] = np.reshape(r["p"], (d, d))
    return out


def classify(rows: DataFrame, label: str, features: Sequence[str], *, mode: str = "none", folds: int = 5, seed: int = 42,
             prior: str = "equal", id_column: str = "recording") -> DataFrame:
    """Predicted class of every row with a label: fitted on all rows, leaving each row out, or by folds."""
    data, classes, k = _numbered(rows, label, features)
    d = len(features)
    if mode == "kfold":
        data = data.withColumn("_key", (draw(seed, F.lit(0), F.xxhash64(id_column) % F.lit(1_000_003) + 1_000_003) % folds).cast("int"))
        part = _blocks(data, "_key", k, d)
        # Training blocks of a fold are the blocks of all other folds.
        models = {f: _solve(*(sum(b[c] for g, b in part.items() if g != f) for c in range(3)), prior) for f in part} if len(part) > 1 else {
            f: _solve(*b, prior) for f, b in part.items()}
    else:
        data = data.withColumn("_key", F.lit(0))
        models = {f: _solve(*b, prior) for f, b in _blocks(data, "_key", k, d).items()}
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = [c for c in data.columns if c not in ("_x", "_key")]
    schema = T.StructType([*(data.schema[c] for c in names), T.StructField("_pred", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                key, y = (some.column(some.schema.get_field_index(c)).to_numpy() for c in ("_key", "_y"))
                x, out = _matrix(some.column(some.schema.get_field_index("_x")), d), np.zeros(some.num_rows, np.int32)
                for f in np.unique(key).tolist():
                    at = np.flatnonzero(key == f)
                    out[at] = _predicted(shared.value[f], x[at], y[at], leave_one_out=mode == "leave_one_out", equal=prior == "equal")
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), pa.array(out)], [*names, "_pred"])

    scored = data.mapInArrow(run, schema)
    answers = classes.select(F.col("_label").alias("predicted"), F.col("_y").alias("_pred"))
    return scored.join(answers, "_pred").drop("_y", "_pred")


def correct_rate(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("ccr"))


#: Most items whose permutation is drawn whole.
DRAWN = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def shuffled(seed: int, perm: int, items: np.ndarray, n: int) -> np.ndarray:
    """Where a permutation of 0 to n - 1 puts the items; 0 is the identity.

    Up to `DRAWN` the permutation is drawn whole. Above, items go through rounds over the halves of their bits, again while
    a place is n or more, so that none of the others need be known.
    """
    if perm == 0 or n < 2:
        return items.astype(np.int64)
    if n <= DRAWN:
        return np.random.default_rng((seed, perm)).permutation(n)[items]
    half = np.uint64(-(-(n - 1).bit_length() // 2))
    low = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for r in range(6):
            h = (right + np.uint64((seed * 1_000_003 + perm) * 8 + r + 1)) * MIX
            h = (h ^ (h >> np.uint64(31))) * MIX
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & low)
        return left << half | right

    out = once(items.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _labels(seed: int, perms: range, at: np.ndarray, own: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Labels of rows (by the number of their holder) under each permutation; permutation 0 leaves a row its own."""
    return np.stack([own if p == 0 else np.searchsorted(ends, shuffled(seed, p, at, int(ends[-1])), side="right") for p in perms])


def permutation_test(rows: DataFrame, label: str, features: Sequence[str], *, permutations: int = 999, seed: int = 42,
                     mode: str = "none", prior: str = "equal", unit: str | None = None, id_column: str = "recording") -> DataFrame:
    """Observed rate, and the share of label permutations that reach it.

    Labels move between rows, or between units (each unit carrying its most frequent label) when `unit` is given.
    """
    data, _, k = _numbered(rows, label, features)
    d = len(features)
    if unit:
        votes = data.groupBy(unit, "_y").agg(F.count(F.lit(1)).alias("_c"))
        holders = votes.groupBy(unit).agg(F.max_by("_y", F.struct("_c", -F.col("_y"))).alias("_l")).withColumnRenamed(unit, "_holder")
    else:
        holders = data.withColumnsRenamed({id_column: "_holder"}).withColumn("_l", F.col("_y"))
    holders = holders.withColumn("_all", F.lit(0)).withColumn("_h", F.col("_l") + F.pmod(F.xxhash64("_holder"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    order = ["_h", "_holder"] if unit else ["_h", "_holder", "_x"]
    holders = plain(row_index(lay_out(holders, "_all", "_h"), "_all", order, "_i")).withColumn("_i", F.col("_i") - 1)
    if unit:
        data = data.join(holders.select(F.col("_holder").alias(unit), "_i", "_l"), unit)
    else:
        data = holders
    data = settled(data.select("_i", "_y", "_x", *(["_holder", "_l"] if not unit else ["_l"])))
    of_class = (holders if unit else data).groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()
    ends = np.zeros(k, np.int64)
    for r in of_class:
        ends[r["_l"]] = r["n"]
    ends = np.cumsum(ends)
    products, n = data.agg(F.array(*[F.sum(F.element_at("_x", i + 1) * F.element_at("_x", j + 1)) for i in range(d) for j in range(d)]), F.count(F.lit(1))).first()
    # Numbering leaves all rows in one task; they are dealt out again, as many as are scored at once.
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)))
    data = data.select("_i", "_y", "_x").repartition(tasks, "_i")
    context, rates = rows.sparkSession.sparkContext, None
    step = max(1, MODEL_NUMBERS // (k * (d + 1) + d * d))
    for first in range(0, permutations + 1, step):
        perms = range(first, min(first + step, permutations + 1))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(perms), k, d + 1))
            size = max(1, ONE_HOT // (k * ROWS))
            for at, y, x in _read(batches, d):
                x = np.hstack((np.ones((len(x), 1)), x))
                for i in range(0, len(perms), size):
                    moved = _labels(seed, perms[i:i + size], at, y, ends)
                    hot = (moved[:, None, :] == np.arange(k)[None, :, None]).reshape(-1, len(x)).astype(np.float64)
                    total[i:i + size] += (hot @ x).reshape(-1, k, d + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(perms)), k)), pa.array(np.tile(np.arange(k), len(perms))),
                pa.array(total.reshape(-1, d + 1).tolist(), pa.list_(pa.float64()))], ["p", "y", "s"])

        sums = data.mapInArrow(add, "p long, y long, s array<double>").groupBy("p", "y").agg(
            F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(d + 1)]).alias("s"))
        found = np.zeros((len(perms), k, d + 1))
        for r in sums.toLocalIterator():
            found[r["p"], r["y"]] = r["s"]
        models = context.broadcast([_solve(f[:, 0], f[:, 1:], np.reshape(products, (d, d)), prior) for f in found])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits, n = np.zeros(len(perms), np.int64), 0
            for at, y, x in _read(batches, d):
                n += len(x)
                for i, p in enumerate(perms):
                    moved = _labels(seed, range(p, p + 1), at, y, ends)[0]
                    hits[i] += (_predicted(models.value[i], x, moved, leave_one_out=mode == "leave_one_out", equal=prior == "equal") == moved).sum()
            yield pa.RecordBatch.from_arrays([pa.array(list(perms), pa.int64()), pa.array(hits), pa.array(np.full(len(perms), n))], ["perm", "hits", "n"])

        some = settled(data.mapInArrow(count, "perm long, hits long, n long").groupBy("perm").agg(
            F.sum("n").alias("n"), (F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("ccr")))
        rates = some if rates is None else rates.union(some)
    # One row per permutation from here on.
    observed = rates.filter("perm = 0").select(F.col("ccr").alias("_obs"), F.lit(1).alias("_one"))
    marked = rates.withColumn("_one", F.lit(1)).join(observed, "_one")
    return marked.agg(
        F.max(F.when(F.col("perm") == 0, F.col("n"))).alias("n"), F.lit(k).alias("n_classes"), F.first("_obs").alias("observed_ccr"),
        F.lit(1.0 / k if k else None).alias("chance_ccr"),
        ((F.count(F.when((F.col("perm") > 0) & (F.col("ccr") >= F.col("_obs")), 1)) + 1) / F.lit(permutations + 1.0)).alias("p"))


def _read(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(holder's number, label, predictors) of rows, some at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.slice(i, ROWS)
            yield some.column(0).to_numpy(), some.column(1).to_numpy(), _matrix(some.column(2), d)


def confusion(predictions: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Counts of actual by predicted class, a column for each given class."""
    return predictions.groupBy(label).pivot("predicted", list(classes)).count().na.fill(0)


def loadings(rows: DataFrame, label: str, features: Sequence[str], axes: int = 2) -> DataFrame:
    """Leading discriminant directions: eigenvectors of within^-1 between, from one block per class."""
    data, _, k = _numbered(rows, label, features)
    d = len(features)
    counts, sums, products = next(iter(_blocks(data.withColumn("_key", F.lit(0)), "_key", k, d).values()))
    means = sums / counts[:, None]
    off = means - sums.sum(0) / counts.sum()
    within = RIDGE * np.eye(d) + products - (means * counts[:, None]).T @ means
    between = (off * counts[:, None]).T @ off
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(-values.real)[: min(axes, d)]
    table = [(f, *[float(vectors.real[i, j]) for j in order]) for i, f in enumerate(features)]
    return rows.sparkSession.createDataFrame(table, ["feature", *[f"ld{i + 1}" for i in range(len(order))]])
