"""Permutation tests against direct computation; what is shuffled does not depend on the number of permutations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.functions.numeric import wide_draw, wide_draw_array
from tactus.operators import distance as di
from tactus.operators import matching as mt


@pytest.fixture(scope="module")
def matrices(spark):
    rng = random.Random(11)
    names = [f"u{i:02d}" for i in range(23)]
    pairs = list(itertools.combinations(names, 2))
    rows = [(x, y, rng.random(), rng.random() + 0.1 * k % 7, rng.random()) for k, (x, y) in enumerate(pairs)]
    full = spark.createDataFrame(rows, "unit_a string, unit_b string, a double, b double, c double")
    return names, rows, full


def brute(names, rows, permutations, seed, partial, drop=()):
    at = {u: i for i, u in enumerate(names)}
    a, b, c = (np.full((len(names),) * 2, np.nan) for _ in range(3))
    for x, y, p, q, r in rows:
        i, j = at[x], at[y]
        a[i, j], c[i, j] = p, r
        b[i, j] = b[j, i] = np.nan if (x, y) in drop else q
    i, j = np.triu_indices(len(names), 1)
    out = []
    for perm in range(permutations + 1):
        to = di.permutation(seed, perm, len(names))
        x, y, z = a[i, j], b[to[i], to[j]], c[i, j]
        ok = ~np.isnan(y)
        x, y, z = x[ok], y[ok], z[ok]
        if partial:
            x, y = (v - np.cov(v, z, bias=True)[0, 1] / (z.var() + 1e-12) * z for v in (x, y))
        out.append(np.corrcoef(x, y)[0, 1])
    return out


@pytest.mark.parametrize("tile", [4, 7, 1024])
@pytest.mark.parametrize("partial", [False, True])
def test_matrix_correlation_by_tiles(spark, matrices, tile, partial, monkeypatch):
    monkeypatch.setattr(di, "TILE", tile)
    names, rows, full = matrices
    one = lambda c: full.select("unit_a", "unit_b", F.col(c).alias("d"))
    for drop in ((), {("u03", "u11"), ("u00", "u22")}):
        b = one("b").withColumn("d", F.when(F.struct("unit_a", "unit_b").isin([F.struct(F.lit(x), F.lit(y)) for x, y in drop]), F.lit(None)).otherwise(F.col("d"))) if drop else one("b")
        got = (di.partial_mantel(one("a"), b, one("c"), permutations=30) if partial else di.mantel(one("a"), b, permutations=30)).first()
        r = brute(names, rows, 30, 42, partial, drop)
        assert got.r_obs == pytest.approx(r[0], abs=1e-9)
        assert got.p == pytest.approx((sum(x >= r[0] - 1e-12 for x in r[1:]) + 1) / 31)


def test_permutations_do_not_add_to_the_shuffle(matrices):
    """The rows that the tasks read are those of the two matrices, at any number of permutations."""
    _, rows, full = matrices
    a, b = (full.select("unit_a", "unit_b", F.col(c).alias("d")) for c in "ab")
    plan = di._permuted(a, b, 999, 42)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode" in plan and "sequence(1" not in plan


def test_draws_in_arrays(spark):
    got = [r[0] for r in spark.range(200).select(wide_draw(42, F.lit(17), F.col("id"))).collect()]
    assert got == wide_draw_array(42, 17, np.arange(200)).tolist()


@pytest.mark.parametrize("tile_units", [5, 1_000])
def test_pairs_of_units_are_built_once(spark, tile_units):
    units = spark.createDataFrame([(f"u{i}", float(i)) for i in range(31)], "name string, x double")
    got = sorted(map(tuple, mt.unit_pairs(units, "name", ["x"], tile_units=tile_units).collect()))
    rows = sorted((f"u{i}", float(i)) for i in range(31))
    assert got == sorted((a, b, x, y) for (a, x), (b, y) in itertools.combinations(rows, 2))


def test_shuffles_are_permutations(monkeypatch):
    from tactus.operators import discriminant as ds
    from tactus.operators.discriminant import shuffled

    seen = {}
    for perm in range(1, 4_801):
        at = tuple(shuffled(7, perm, np.arange(4), 4).tolist())
        assert sorted(at) == [0, 1, 2, 3]
        seen[at] = seen.get(at, 0) + 1
    assert len(seen) == 24 and 120 < min(seen.values()) and max(seen.values()) < 290
    monkeypatch.setattr(ds, "DRAWN", 10)
    found = np.stack([shuffled(1, perm, np.arange(1_000), 1_000) for perm in range(1, 200)])
    assert (np.sort(found, 1) == np.arange(1_000)).all()
    assert abs(found.mean(0) - 499.5).max() < 100 and abs(np.corrcoef(found[:, 0], found[:, 1])[0, 1]) < 0.25
    assert (shuffled(1, 3, np.array([5, 900]), 1_000) == found[2][[5, 900]]).all()


@pytest.mark.parametrize("unit", [None, "unit"])
@pytest.mark.parametrize("mode", ["none", "leave_one_out"])
def test_label_permutations_equal_refitting(spark, unit, mode, monkeypatch):
    """Every permutation's rate is that of a model fitted on rows with the permuted labels."""
    from tactus.operators import discriminant as ds

    rng = np.random.default_rng(3)
    monkeypatch.setattr(ds, "ROWS", 11)
    monkeypatch.setattr(ds, "MODEL_NUMBERS", 150)  # several passes
    rows = [(f"r{i:02d}", "abc"[i % 3], f"u{i % 3}{i % 5}", *map(float, rng.normal(size=3) + i % 3)) for i in range(60)]
    table = spark.createDataFrame(rows, "recording string, grp string, unit string, p double, q double, s double").repartition(4)
    got = ds.permutation_test(table, "grp", ["p", "q", "s"], permutations=20, mode=mode, unit=unit).first()
    # the same numbering of holders as in Spark
    label = {r[0]: "abc".index(r[1]) for r in rows}
    if unit:
        label = {u: max("abc", key=lambda c: (sum(r[2] == u and r[1] == c for r in rows), -"abc".index(c))) for u in {r[2] for r in rows}}
        label = {u: "abc".index(c) for u, c in label.items()}
    holders = spark.createDataFrame(list(label.items()), "h string, l int").select("h", (F.col("l") + F.pmod(F.xxhash64("h"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("o"), "l")
    order = {r.h: (i, r.l) for i, r in enumerate(sorted(holders.collect(), key=lambda r: (r.o, r.h)))}
    of = [order[r[2] if unit else r[0]] for r in rows]
    n, ends = len(label), np.cumsum([sum(l == c for l in label.values()) for c in range(3)])
    x, own = np.array([r[3:] for r in rows]), np.array(["abc".index(r[1]) for r in rows])

    def predict(x, y, v):
        means = np.array([x[y == c].mean(0) if (y == c).any() else np.zeros(3) for c in range(3)])
        within = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)) / (len(x) - 3)
        inv = np.linalg.pinv(within + 1e-8 * np.eye(3))
        return np.argmax([m @ inv @ v - m @ inv @ m / 2 for m in means])

    rates = []
    for perm in range(21):
        y = own if perm == 0 else np.searchsorted(ends, ds.shuffled(42, perm, np.array([i for i, _ in of]), n), side="right")
        keep = lambda i: np.arange(60) != i if mode == "leave_one_out" else np.full(60, True)
        rates.append(np.mean([predict(x[keep(i)], y[keep(i)], x[i]) == y[i] for i in range(60)]))
    assert got.n == 60 and got.n_classes == 3 and got.observed_ccr == pytest.approx(rates[0])
    assert got.p == pytest.approx((sum(r >= rates[0] - 1e-12 for r in rates[1:]) + 1) / 21)


def test_no_row_is_repeated_per_permutation(spark):
    from tactus.operators import discriminant as ds

    rows = spark.createDataFrame([(f"r{i}", "ab"[i % 2], float(i % 7), float(i % 5)) for i in range(40)], "recording string, grp string, p double, q double")
    one = ds.permutation_test(rows, "grp", ["p", "q"], permutations=1)
    many = ds.permutation_test(rows, "grp", ["p", "q"], permutations=400)
    shape = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shape(one) == shape(many) and many.first().n == 40
