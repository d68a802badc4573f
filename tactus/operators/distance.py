"""Distances between units and matrix correlation by permutation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions.numeric import haversine_km, wide_draw_array
from tactus.layout import average_ranks, row_index
from tactus.operators.matching import unit_pairs
from tactus.session import settled

#: Units along a side of a tile of two permuted matrices.
TILE = 1_024


def metric_distances(units: DataFrame, metric: str, *, unit: str = "unit") -> DataFrame:
    """Absolute difference of one metric: unit_a < unit_b, d."""
    pairs = unit_pairs(units, unit, [metric])
    return pairs.select("unit_a", "unit_b", F.abs(F.col(f"{metric}_a") - F.col(f"{metric}_b")).alias("d"))


def multivariate_distances(units: DataFrame, metrics: Sequence[str], *, unit: str = "unit") -> DataFrame:
    """Euclidean distance over standardised metrics."""
    row = units.agg(*[F.avg(m).alias(f"m_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"s_{m}") for m in metrics]).first()
    scaled = units.withColumns({m: (F.col(m) - row[f"m_{m}"]) / F.lit(row[f"s_{m}"] + 1e-12) for m in metrics})
    pairs = unit_pairs(scaled, unit, metrics)
    square = lambda m: F.pow(F.col(f"{m}_a") - F.col(f"{m}_b"), 2)
    return pairs.select("unit_a", "unit_b", F.sqrt(sum((square(m) for m in metrics[1:]), square(metrics[0]))).alias("d"))


def geographic_distances(units: DataFrame, *, lat: str = "lat", lon: str = "lon", unit: str = "unit", planar: bool = False) -> DataFrame:
    """Great-circle kilometres, or the plain distance of the coordinates."""
    pairs = unit_pairs(units, unit, [lat, lon])
    a, b = (F.col(f"{lat}_a"), F.col(f"{lon}_a")), (F.col(f"{lat}_b"), F.col(f"{lon}_b"))
    d = F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)) if planar else haversine_km(*a, *b)
    return pairs.select("unit_a", "unit_b", d.alias("d"))


def wide_matrix(distances: DataFrame, units: Sequence[str]) -> DataFrame:
    """Matrix with one column per given unit, zero on the diagonal; the distances in long form are the general result."""
    flipped = distances.select(F.col("unit_b").alias("unit_a"), F.col("unit_a").alias("unit_b"), "d")
    both = distances.unionByName(flipped)
    diagonal = both.select("unit_a").distinct().select("unit_a", F.col("unit_a").alias("unit_b"), F.lit(0.0).alias("d"))
    return both.unionByName(diagonal).groupBy("unit_a").pivot("unit_b", list(units)).agg(F.first("d"))


def _ranked(distances: DataFrame) -> DataFrame:
    rows = distances.withColumn("_all", F.lit(0))
    ranks = average_ranks(rows, "_all", "d").select("d", "avg_rank")
    return rows.join(ranks, "d").select("unit_a", "unit_b", F.col("avg_rank").alias("d"))


def permutation(seed: int, perm: int, n: int) -> np.ndarray:
    """Which of n ordered items takes the place of each; permutation 0 is the identity."""
    items = np.arange(n, dtype=np.int64)
    if perm == 0:
        return items
    at = np.empty(n, np.int64)
    at[np.lexsort((items, wide_draw_array(seed, perm, items)))] = items
    return at


#: Sums of a permutation over pairs that have all their distances.
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab", "sc", "scc", "sac", "sbc")


def _sums(rows: dict[str, np.ndarray], other: dict[str, np.ndarray], spots: tuple[int, int, int, int], at: np.ndarray, tile: int) -> np.ndarray:
    """The sums of one permutation over the pairs of a tile whose stand-ins lie in a tile of the other matrix."""
    i, j, k, l = spots
    out = np.zeros(len(SUMS))
    for x, y in ((k, l), (l, k))[:1 if k == l else 2]:
        a = np.flatnonzero(at[i * tile:(i + 1) * tile] // tile == x)
        b = np.flatnonzero(at[j * tile:(j + 1) * tile] // tile == y)
        if not len(a) or not len(b):
            continue
        to_a, to_b = at[a + i * tile] - x * tile, at[b + j * tile] - y * tile
        db = other["b"][np.ix_(to_a, to_b)] if (x, y) == (k, l) else other["b"][np.ix_(to_b, to_a)].T
        da = rows["a"][np.ix_(a, b)]
        dc = rows["c"][np.ix_(a, b)] if "c" in rows else np.zeros_like(da)
        ok = ~(np.isnan(da) | np.isnan(db) | np.isnan(dc))
        da, db, dc = da[ok], db[ok], dc[ok]
        out += [len(da), da.sum(), db.sum(), da @ da, db @ db, da @ db, dc.sum(), dc @ dc, da @ dc, db @ dc]
    return out


def _dense(table: pa.Table, names: Sequence[str], spots: tuple[int, int], tile: int, n: int, whole: bool) -> dict[str, np.ndarray]:
    """A tile as matrices, NaN where there is no pair; `whole` fills both triangles of a tile on the diagonal."""
    i, j = table["i"].to_numpy() - spots[0] * tile, table["j"].to_numpy() - spots[1] * tile
    out = {}
    for name in names:
        matrix = np.full([min(tile, n - k * tile) for k in spots], np.nan)
        d = pc.cast(table[name], pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)
        matrix[i, j] = d
        if whole and spots[0] == spots[1]:
            matrix[j, i] = d
        out[name] = matrix
    return out


def _permuted(a: DataFrame, b: DataFrame, permutations: int, seed: int) -> DataFrame:
    """One row of sums per permutation of the units of `b` (0: none): perm and `SUMS`.

    Units are numbered and both matrices cut into tiles of `TILE` units a side, upper triangle only. A task has a tile of
    each and goes through all permutations, gathering the stand-ins' distances from its tile; the tasks' sums are added.
    So what is shuffled are the two matrices, once per tile of the other, however many permutations there are.
    """
    units = a.select(F.explode(F.array("unit_a", "unit_b")).alias("unit")).distinct().withColumn("_all", F.lit(0))
    units = settled(row_index(units, "_all", "unit", "_i").select("unit", (F.col("_i") - 1).alias("_i")))
    n, tile = units.count(), TILE
    tiles = max(1, -(-n // tile))

    def placed(rows: DataFrame, first: str, second: str) -> DataFrame:
        rows = rows.join(units.select(F.col("unit").alias("unit_a"), F.col("_i").alias("i")), "unit_a").join(
            units.select(F.col("unit").alias("unit_b"), F.col("_i").alias("j")), "unit_b").drop("unit_a", "unit_b")
        return rows.withColumns({first: F.floor(F.col("i") / tile).cast("int"), second: F.floor(F.col("j") / tile).cast("int")})

    spots = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(tiles) for y in range(x, tiles)]
    each = F.explode(F.array(*spots)).alias("_spot")
    extra = [c for c in a.columns if c not in ("unit_a", "unit_b", "d")]
    left = placed(a.withColumnRenamed("d", "a"), "ti", "tj").select("i", "j", "a", *extra, "ti", "tj", each).select("*", F.col("_spot.x").alias("tk"), F.col("_spot.y").alias("tl")).drop("_spot")
    right = placed(b.select("unit_a", "unit_b", F.col("d").alias("b")), "tk", "tl").select("i", "j", "b", "tk", "tl", each).select("*", F.col("_spot.x").alias("ti"), F.col("_spot.y").alias("tj")).drop("_spot")
    by = ["ti", "tj", "tk", "tl"]

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and two.num_rows:
            at = tuple(one[c][0].as_py() for c in by)
            rows = _dense(one, ["a", *extra], at[:2], tile, n, False)
            other = _dense(two, ["b"], at[2:], tile, n, True)
            found = [(perm, *_sums(rows, other, at, permutation(seed, perm, n), tile)) for perm in range(permutations + 1)]
        columns = list(zip(*found)) or [[]] * (1 + len(SUMS))
        return pa.table({"perm": pa.array(columns[0], pa.int32()), **{c: pa.array(columns[k + 1], pa.float64()) for k, c in enumerate(SUMS)}})

    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "perm int, " + ", ".join(f"{c} double" for c in SUMS))
    return sums.groupBy("perm").agg(*[F.sum(c).alias(c) for c in SUMS])


#: Sums are put together in another order for each permutation; a correlation this close to the observed one equals it.
SAME = 1e-12


def _p_value(rs: DataFrame, alternative: str) -> DataFrame:
    """Observed correlation and its permutation p-value from one correlation per permutation (0 = observed)."""
    size = F.abs if alternative == "two-sided" else (lambda c: c)
    obs = F.max(F.when(F.col("perm") == 0, F.col("r"))).over(Window.partitionBy())
    rows = rs.withColumn("r_obs", obs)  # one row per permutation
    hits = F.count(F.when((F.col("perm") > 0) & (size(F.col("r")) >= size(F.col("r_obs")) - SAME), 1))
    return rows.groupBy("r_obs").agg(((hits + 1) / (F.count(F.when(F.col("perm") > 0, 1)) + 1)).alias("p"))


def _cov(x: str, y: str) -> Column:
    pair = f"s{x}{y}" if x <= y else f"s{y}{x}"
    return (F.col(pair) - F.col(f"s{x}") * F.col(f"s{y}") / F.col("n")) / F.col("n")


def mantel(a: DataFrame, b: DataFrame, *, permutations: int = 999, seed: int = 42, method: str = "pearson",
           alternative: str = "greater") -> DataFrame:
    """Correlation of two distance matrices; p from permuting the units of the second."""
    if method == "spearman":
        a, b = _ranked(a), _ranked(b)
    sums = _permuted(a, b, permutations, seed)
    r = _cov("a", "b") / F.nullif(F.sqrt(_cov("a", "a") * _cov("b", "b")), F.lit(0.0))
    return _p_value(sums.select("perm", r.alias("r")), alternative)


def partial_mantel(a: DataFrame, b: DataFrame, c: DataFrame, *, permutations: int = 999, seed: int = 42,
                   method: str = "pearson", alternative: str = "greater") -> DataFrame:
    """Correlation of two matrices after removing the linear effect of a third; null below five pairs.

    Everything follows from covariances, so each permutation is one row of sums. `spearman` takes the ranks of all three.
    """
    if method == "spearman":
        a, b, c = _ranked(a), _ranked(b), _ranked(c)
    a = a.join(c.select("unit_a", "unit_b", F.col("d").alias("c")), ["unit_a", "unit_b"])
    sums = settled(_permuted(a, b, permutations, seed))
    sa, sb = _cov("a", "c") / (_cov("c", "c") + 1e-12), _cov("b", "c") / (_cov("c", "c") + 1e-12)
    num = _cov("a", "b") - sb * _cov("a", "c") - sa * _cov("b", "c") + sa * sb * _cov("c", "c")
    va = _cov("a", "a") - 2 * sa * _cov("a", "c") + sa * sa * _cov("c", "c")
    vb = _cov("b", "b") - 2 * sb * _cov("b", "c") + sb * sb * _cov("c", "c")
    r = num / F.nullif(F.sqrt(va * vb), F.lit(0.0))
    out = _p_value(sums.select("perm", r.alias("r")), alternative)
    enough = sums.filter("perm = 0").select("n").first()
    few: Column = F.lit((enough or [0])[0] < 5)
    return out.select(F.when(~few, F.col("r_obs")).alias("r_obs"), F.when(~few, F.col("p")).alias("p"))
