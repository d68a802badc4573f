"""Product codes of vectors, in exact integer arithmetic.

Components become integers floor(scale * x). Vectors are cut into equal parts; each part position has a codebook, which
starts as that part of the first vectors by id and is refined by rounds of nearest entry and componentwise floor of the
mean. Distances are compared through dot products: integers are cut into signed limbs so small that a float64 matrix
product of two limbs stays below 2^53 and is exact; the products are put together in int64, and the first least entry
wins. Components so large that int64 could not hold a distance are handled with Python's integers, also exactly.

Every round is one pass over the vectors. A task sends one row per used entry, position and limb of a sum; Spark adds
them, and only the codebooks (parts x entries x positions) come to the driver and go out again with the next round.

Rows whose vector is null or holds a null, infinite or NaN component are dropped. All kept vectors must have one length
that the parts divide, else a ValueError. Equal ids: the smaller integers come first; null ids come last. Fewer vectors
than entries: codebooks are that short. No vectors: an empty result. Errors beyond 64 bits are null. Extra columns are
not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.llm.common import lean, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors handled at once inside a task.
ROWS = 8_192
#: Sums leave a task in limbs of so many bits, so that adding them in Spark can't pass 64 bits before 2^23 tasks' rows.
SUM_BITS = 40


def integers(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the rows that hold whole finite vectors, and floor(scale * x) of their components as floats.

    A product with a power of two and a floor are exact in float64.
    """
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=len(lengths)) > 0
    kept = valid & ~bad
    rows = np.flatnonzero(kept)
    if len(rows) and (lengths[rows] != lengths[rows[0]]).any():
        raise ValueError("vectors differ in length")
    return rows, np.floor(values[kept[owner]] * scale).reshape(len(rows), lengths[rows[0]] if len(rows) else 0)


def _whole(values: np.ndarray) -> np.ndarray:
    """Integers as int64 where they fit with room for distances, else as Python's integers."""
    if not values.size or np.abs(values).max() * 2 < (2 ** 63 / max(1, values.shape[-1])) ** 0.5:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed limbs of int64 values as float64: values == sum(limb[k] << (bits * k)), each within 2^bits."""
    most, out = int(np.abs(values).max()) if values.size else 0, []
    while True:
        if most < 1 << bits:
            return [*out, values.astype(np.float64)]
        high = values >> bits
        out.append((values - (high << bits)).astype(np.float64))
        values, most = high, (most >> bits) + 1


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of int64 matrices whose products fit int64."""
    bits = (53 - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest entry of each row, and its squared distance."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
        found = [min((sum((p - q) ** 2 for p, q in zip(row, entry)), k) for k, entry in enumerate(book)) for row in x]
        return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found], object)
    half = (book * book).sum(1)[None, :] - 2 * dots(x, book)
    at = half.argmin(1)
    return at, half[np.arange(len(x)), at] + (x * x).sum(1)


@dataclass(frozen=True)
class Codebooks:
    """parts x entries x positions."""

    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()


def _parts(values: np.ndarray, parts: int) -> list[np.ndarray]:
    if values.shape[1] % parts:
        raise ValueError(f"vectors of {values.shape[1]} components can't be cut into {parts} equal parts")
    width = values.shape[1] // parts
    return [_whole(values[:, p * width:(p + 1) * width]) for p in range(parts)]


def _blocks(batch: pa.RecordBatch, column: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        rows, values = integers(part.column(column), scale)
        if len(rows):
            yield part, rows, values


def _first(vectors: DataFrame, vec_col: str, entries: int, scale: int) -> np.ndarray:
    """The integers of the first vectors by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, values in _blocks(batch, 1, scale):
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(list(values), pa.list_(pa.float64()))], ["vec_id", "ints"])

    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("ints", T.ArrayType(T.DoubleType()))])
    found = vectors.select("vec_id", vec_col).mapInArrow(lean(run), schema)
    rows = found.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if len({len(r.ints) for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    return np.array([r.ints for r in rows], np.float64)


def _sums(vectors: DataFrame, vec_col: str, model: Codebooks, scale: int) -> dict[tuple[int, int, int], int]:
    """Sums by (part, entry, position), and counts at position -1, of the vectors nearest to each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, _, values in _blocks(batch, 0, scale):
                for p, (x, book) in enumerate(zip(_parts(values, len(model.books)), model.books)):
                    at, _ = nearest(x, book)
                    order = np.argsort(at, kind="stable")
                    used, start, count = np.unique(at[order], return_index=True, return_counts=True)
                    for k, n, s in zip(used.tolist(), count.tolist(), np.add.reduceat(x[order], start, axis=0).astype(object)):
                        m, t = total.get((p, k), (0, 0))
                        total[p, k] = m + n, t + s
        rows = []
        for (p, k), (n, s) in total.items():
            for position, value in [(-1, n), *enumerate(s)]:
                limb, value = 0, int(value)
                while True:  # the last limb carries the sign
                    last = abs(value) < 1 << SUM_BITS
                    rows.append((p, k, position, limb, value if last else value & ((1 << SUM_BITS) - 1)))
                    if last:
                        break
                    limb, value = limb + 1, value >> SUM_BITS
        names = ["part", "entry", "position", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names)

    found = vectors.select(vec_col).mapInArrow(lean(run), "part long, entry long, position long, limb long, value long")
    out: dict[tuple[int, int, int], int] = {}
    for r in found.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        at = r.part, r.entry, r.position
        out[at] = out.get(at, 0) + (r.value << (SUM_BITS * r.limb))
    return out


def fit(vectors: DataFrame, vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after the rounds; none without vectors."""
    first = _first(vectors, vec_col, entries, scale)
    if not len(first):
        return None
    model = Codebooks(_parts(first, parts))
    for _ in range(rounds):
        sums = _sums(vectors, vec_col, model, scale)
        books = [b.astype(object) for b in model.books]
        for (p, k, position), value in sums.items():
            if position >= 0:
                books[p][k, position] = value // sums[p, k, -1]
        model = Codebooks([_whole_integers(b) for b in books])
    return model


def _whole_integers(book: np.ndarray) -> np.ndarray:
    most = max((abs(v) for v in book.ravel()), default=0)
    return book.astype(np.int64) if 2 * most < (2 ** 63 / max(1, book.shape[1])) ** 0.5 else book


def encode(vectors: DataFrame, model: Codebooks | None, vec_col: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the columns of `keep`, code (an index per part, as bytes) and error (squared distance to the decoded vector)."""
    names = ["vec_id", *keep]
    schema = T.StructType([*(vectors.schema[c] for c in names), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows, values in _blocks(batch, len(names), scale):
                found = [nearest(x, book) for x, book in zip(_parts(values, len(model.books)), model.books)]
                codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
                error = sum(d.astype(object) for _, d in found)
                own = [part.column(c).take(pa.array(rows)) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*own, pa.array([c.tobytes() for c in codes], pa.binary()),
                                                  pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], [*names, "code", "error"])

    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select(*names, vec_col).mapInArrow(lean(run), schema)


def decode(model: Codebooks, code: bytes) -> list[int]:
    """The integers that a code stands for."""
    return [int(v) for book, k in zip(model.books, code) for v in book[k]]


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds label_error: the errors summed over equal labels, nulls together; rows are combined before the shuffle."""
    coded = stored(coded, "codes")
    sums = coded.groupBy(F.col(label_col).alias("of_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("of_label")), "left").drop("of_label")
