"""Tail probabilities against enumeration and known values."""

import itertools
import math
import random

import pytest

from tactus.functions import tails


def test_signed_rank_matches_enumeration():
    n = 7
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product([0, 1], repeat=n)]
    for v in range(0, n * (n + 1) // 2 + 1):
        assert tails.signed_rank_p(v, n, 0.0, "greater") == pytest.approx(sum(s >= v for s in sums) / 2**n)
        assert tails.signed_rank_p(v, n, 0.0, "less") == pytest.approx(sum(s <= v for s in sums) / 2**n)


def test_rank_sum_matches_enumeration():
    n1, n2 = 4, 6
    us = []
    for pick in itertools.combinations(range(1, n1 + n2 + 1), n1):
        us.append(sum(pick) - n1 * (n1 + 1) / 2)
    for u in range(0, n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        assert tails.rank_sum_p(u, n1, n2, 0.0) == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))


def test_two_sample_ks_matches_enumeration():
    n1, n2 = 4, 5
    ds = []
    for pick in itertools.combinations(range(n1 + n2), n1):
        a = b = d = 0
        for i in range(n1 + n2):
            a, b = (a + 1, b) if i in pick else (a, b + 1)
            d = max(d, abs(a / n1 - b / n2))
        ds.append(d)
    for d in sorted(set(ds)):
        assert tails.ks_two_sample_p(d, n1, n2) == pytest.approx(sum(x >= d - 1e-9 for x in ds) / len(ds))


def test_one_sample_ks():
    # For one value D = max(x, 1 - x), so P(D >= d) = 2 (1 - d).
    assert tails.ks_one_sample_p(0.7, 1) == pytest.approx(0.6)
    rng = random.Random(3)
    n, d, hits = 6, 0.4, 0
    for _ in range(20_000):
        xs = sorted(rng.random() for _ in range(n))
        hits += max(max((i + 1) / n - x, x - i / n) for i, x in enumerate(xs)) >= d
    assert tails.ks_one_sample_p(d, n) == pytest.approx(hits / 20_000, abs=0.015)
    assert tails.ks_one_sample_p(0.02, 9_000) == pytest.approx(tails.kolmogorov_limit(0.02 * math.sqrt(9_000)), abs=0.01)
    assert tails.ks_one_sample_p(0.01, 20_000) == pytest.approx(tails.kolmogorov_limit(0.01 * math.sqrt(20_000)))


def test_chi_square_and_normal():
    assert tails.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.two_sided_normal(1.959963984540054) == pytest.approx(0.05)


def test_one_sided_ks_matches_enumeration():
    for n1, n2 in ((3, 5), (4, 4), (6, 3)):
        largest = []
        for pick in itertools.combinations(range(n1 + n2), n1):
            a = b = 0
            top = 0.0
            for k in range(n1 + n2):
                a, b = (a + 1, b) if k in pick else (a, b + 1)
                top = max(top, a / n1 - b / n2)
            largest.append(top)
        for d in sorted(set(largest)):
            assert tails.ks_one_way_p(d, n1, n2) == pytest.approx(sum(x >= d - 1e-12 for x in largest) / len(largest))
    assert tails.ks_one_way_p(0.0, 5, 5) == 1.0
    exact, tails.EXACT_PATHS = tails.EXACT_PATHS, 0
    try:
        limit = tails.ks_one_way_p(0.2, 200, 150)
    finally:
        tails.EXACT_PATHS = exact
    assert limit == pytest.approx(tails.ks_one_way_p(0.2, 200, 150), rel=0.1)


def test_distances_to_a_given_null(spark):
    from tactus.operators import stats

    rng = random.Random(6)
    groups = {g: [round(rng.betavariate(a, 2), 2) for _ in range(n)] for g, a, n in (("a", 1, 40), ("b", 4, 25), ("c", 2, 1))}
    null = [round(rng.random(), 2) for _ in range(60)] + [None]
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "grp string, r_k double")
    share = lambda vs, x: sum(v <= x for v in vs) / len(vs)
    known = [v for v in null if v is not None]
    for alternative in ("two-sided", "greater", "less"):
        found = {r.grp: r for r in stats.ks_against(rows, spark.createDataFrame([(v,) for v in null], "r_k double"), alternative=alternative).collect()}
        assert found["c"].d is None and found["c"].p is None
        for g in "ab":
            diffs = [share(groups[g], x) - share(known, x) for x in {*groups[g], *known}]
            want = {"greater": max(0, max(diffs)), "less": max(0, -min(diffs)), "two-sided": max(map(abs, diffs))}[alternative]
            assert found[g].d == pytest.approx(want) and found[g].n == len(groups[g]) and found[g].n_null == 60
            p = tails.ks_two_sample_p(want, found[g].n, 60) if alternative == "two-sided" else tails.ks_one_way_p(want, found[g].n, 60)
            assert found[g].p == pytest.approx(p)
