"""Tests between groups of recordings and resampling.

Statistics come from counts of distinct values in order (`running` over value runs), so a group of any size is
spread over tasks. Tail probabilities are taken on the finished one-row-per-test results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions import tails
from tactus.functions.numeric import DRAW_MODULUS, DRAW_OFFSET, ratio, wide_draw
from tactus.layout import as_list, average_ranks, lay_out, plain, plan_layout, row_index, running, shift
from tactus.session import settled

# Cumulative probabilities of the Poisson law with mean 1 for 0 to 12 events; more are rarer than a draw's resolution.
POISSON_ONE = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13))


def ks_uniform(rows: DataFrame, value: str = "r_k", key: str = "grp") -> DataFrame:
    """Kolmogorov-Smirnov distance to Uniform(0, 1) per group, where it is reached, and its p-value; null below two rows."""
    ranked = average_ranks(rows, key, value)
    n = ranked.groupBy(key).agg(F.sum("n_equal").alias("n"))
    ranked = ranked.join(n, key)
    x = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    above = F.col("cum") / F.col("n") - x
    below = x - (F.col("cum") - F.col("n_equal")) / F.col("n")
    gap = F.greatest(above, below)
    best = ranked.groupBy(key).agg(F.max(gap).alias("d"), F.max_by(F.col(value), F.struct(gap, -F.col(value))).alias("at"),
                                   F.first("n").alias("n"))
    d = F.when(F.col("n") >= 2, F.col("d"))
    return best.select(key, "n", d.alias("d"), F.col("at"), tails.ks_one_sample(d, F.col("n")).alias("p"))


def ks_rest(rows: DataFrame, value: str = "r_k", key: str = "grp") -> DataFrame:
    """Distance of each group to all other groups pooled, with the point and both distribution values there.

    The pool is every row outside the group. Its distribution follows from total minus own counts, so the data
    is not repeated per group. Only the group's own values need checking: the distance peaks at one of them or
    just before one.
    """
    counted = settled(rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c")))
    overall = counted.groupBy(value).agg(F.sum("_c").alias("_all")).withColumn("_one", F.lit(0))
    layout = plan_layout(overall, "_one", value)
    overall = running(layout.mark(overall), "_one", value, {"_cum_all": ("sum", "_all")})
    overall = plain(shift(overall, "_one", value, {"_before": (value, -1)}))
    own = plan_layout(counted, key, value).mark(counted)
    own = plain(running(own, key, value, {"_cum": ("sum", "_c")}))
    rows_ = own.join(overall.drop("_one"), value)
    sizes = counted.groupBy(key).agg(F.sum("_c").alias("n"))
    total = sizes.agg(F.sum("n").alias("t")).first()["t"] or 0
    rows_ = rows_.join(sizes, key)
    rest = F.lit(total) - F.col("n")
    share = lambda c: ratio(c.cast("double"), rest)
    here = F.struct((F.col("_cum") / F.col("n")).alias("f_group"), share(F.col("_cum_all") - F.col("_cum")).alias("f_rest"),
                    F.col(value).alias("x"))
    gone, gone_all = F.col("_cum") - F.col("_c"), F.col("_cum_all") - F.col("_all")
    before = F.struct((gone / F.col("n")).alias("f_group"), share(gone_all - gone).alias("f_rest"), F.col("_before").alias("x"))
    points = rows_.withColumn("_p", F.explode(F.array(here, before))).filter("_p.x IS NOT NULL AND _p.f_rest IS NOT NULL")
    dev = F.abs(F.col("_p.f_group") - F.col("_p.f_rest"))
    best = points.groupBy(key).agg(F.max(dev).alias("d"), F.max_by("_p", F.struct(dev, -F.col("_p.x"))).alias("_b"),
                                   F.first("n").alias("n"))
    enough = (F.col("n") >= 2) & (F.lit(total) - F.col("n") >= 2)
    return best.select(
        key, "n", (F.lit(total) - F.col("n")).alias("n_rest"), F.when(enough, F.col("d")).alias("d"), F.col("_b.x").alias("at"),
        F.col("_b.f_group").alias("f_group"), F.col("_b.f_rest").alias("f_rest"),
        tails.ks_two_sample(F.when(enough, F.col("d")), F.col("n"), F.lit(total) - F.col("n")).alias("p"))


def resample_rest(rows: DataFrame, draws: int, seed: int, value: str = "r_k", key: str = "grp") -> DataFrame:
    """`draws` values per group, taken with replacement from the rows of the other groups.

    Positions are drawn by hash and looked up in the cumulative counts of the pool. (group, value, n).
    """
    counted = settled(rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c")))
    groups = sorted((r[0] for r in counted.select(key).distinct().collect()), key=str)  # names of groups, few by meaning
    # One pool per target group: distinct values with counts, repeated once per other group.
    pool = counted.withColumnRenamed(key, "_g").withColumn(key, F.explode(F.array(*[F.lit(g) for g in groups]))).filter(
        ~F.col("_g").eqNullSafe(F.col(key))).groupBy(key, value).agg(F.sum("_c").alias("_c"))
    pool = plain(running(plan_layout(pool, key, value).mark(pool), key, value, {"_cum": ("sum", "_c")}))
    sizes = pool.groupBy(key).agg(F.max("_cum").alias("_n"))
    wanted = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(
        key, (wide_draw(seed, F.hash(key).cast("long") % 1000003 + 1000003, F.col("_i")) % F.col("_n") + 1).alias("_at"))
    picks = wanted.groupBy(key, "_at").agg(F.count(F.lit(1)).alias("n"))
    marks = pool.select(key, F.col("_cum").alias("_at"), F.lit(1).alias("_side"), F.struct("_cum", value).alias("_v"))
    both = picks.withColumn("_side", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    both = plan_layout(both, key, "_at").mark(both)
    both = running(both, key, ["_at", "_side"], {"_hit": ("min", "_v")}, reverse=True)
    return both.filter("_side = 0").groupBy(key, F.col(f"_hit.{value}").alias(value)).agg(F.sum("n").alias("n"))


def ks_against(rows: DataFrame, null: DataFrame, value: str = "r_k", key: str = "grp", *, alternative: str = "two-sided") -> DataFrame:
    """Distance of each group to a given null sample (a table with the same value column), the point and the p-value.

    `greater`: the group's distribution lies above the null's (its values are smaller), `less`: below, `two-sided`: either.
    Groups or null samples of fewer than two values have no distance. The null is counted once and meets the groups'
    different values in one order, so it is not repeated per group.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(alternative)
    counted = settled(rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    nulls = settled(null.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m")))
    total = nulls.agg(F.sum("_m")).first()[0] or 0
    both = nulls.unionByName(counted.select("_v").distinct().withColumn("_m", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_m").alias("_m")).withColumn("_one", F.lit(0))
    both = plain(running(plan_layout(both, "_one", "_v").mark(both), "_one", "_v", {"_null": ("sum", "_m")})).drop("_one")
    own = plain(running(plan_layout(counted, key, "_v").mark(counted), key, "_v", {"_cum": ("sum", "_c")}))
    points = own.join(both, "_v").join(counted.groupBy(key).agg(F.sum("_c").alias("n")), key)
    share = lambda c: c / F.lit(float(total)) if total else F.lit(None).cast("double")
    above = F.col("_cum") / F.col("n") - share(F.col("_null"))
    below = share(F.col("_null") - F.col("_m")) - (F.col("_cum") - F.col("_c")) / F.col("n")
    gap = {"greater": above, "less": below, "two-sided": F.greatest(above, below)}[alternative]
    best = points.groupBy(key).agg(F.first("n").alias("n"), F.greatest(F.max(gap), F.lit(0.0)).alias("d"), F.max_by("_v", F.struct(gap, -F.col("_v"))).alias("at"))
    n_null = F.lit(total).cast("long")
    d = F.when((F.col("n") >= 2) & (n_null >= 2), F.col("d"))
    tail = tails.ks_two_sample if alternative == "two-sided" else tails.ks_one_way
    return best.select(key, "n", n_null.alias("n_null"), d.alias("d"), "at", tail(d, F.col("n"), n_null).alias("p"))


def two_samples(rows: DataFrame, keys: str | Sequence[str], value: str, side: Column, times: Column | None = None) -> DataFrame:
    """Rank-sum U, its tie term and the two-sample KS distance for each key; `side` is true for the first sample.

    `times` says how often a row counts.
    """
    keys = as_list(keys)
    times = F.lit(1).cast("long") if times is None else times
    number = lambda which: F.sum(F.when(which, times).otherwise(F.lit(0).cast("long")))
    counted = settled(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(number(side).alias("_a"), number(~side).alias("_b")))
    layout = plan_layout(counted, keys, value)
    ranked = plain(running(layout.mark(counted), keys, value, {"_ca": ("sum", "_a"), "_cb": ("sum", "_b")}))
    sizes = counted.groupBy(*keys).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))
    ranked = ranked.join(sizes, keys)
    t = (F.col("_a") + F.col("_b")).cast("double")
    rank = F.col("_ca") + F.col("_cb") - t + (t + 1) / 2
    dev = F.abs(ratio(F.col("_ca").cast("double"), F.col("n_a")) - ratio(F.col("_cb").cast("double"), F.col("n_b")))
    out = ranked.groupBy(*keys).agg(
        F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum(F.col("_a") * rank).alias("_ra"),
        F.sum(t * t * t - t).alias("tie_term"), F.max(dev).alias("d"))
    n_a = F.col("n_a")
    return out.withColumn("u", F.col("_ra") - n_a * (n_a + 1) / F.lit(2.0)).drop("_ra")


def signed_rank(rows: DataFrame, value: str, centre: float, key: str = "grp", alternative: str = "two-sided") -> DataFrame:
    """Wilcoxon signed-rank statistic of value - centre per group; zeros are dropped, fewer than two rows give null."""
    diffs = settled(rows.select(key, (F.col(value) - F.lit(centre)).alias("_d")))
    sizes = diffs.groupBy(key).agg(F.count("_d").alias("n_units"))
    live = diffs.filter("_d <> 0").select(key, F.abs("_d").alias("_m"), (F.col("_d") > 0).alias("_pos"))
    counted = live.groupBy(key, "_m").agg(F.count(F.lit(1)).alias("_t"), F.count(F.when(F.col("_pos"), 1)).alias("_p"))
    ranked = plain(running(plan_layout(counted, key, "_m").mark(counted), key, "_m", {"_cum": ("sum", "_t")}))
    t = F.col("_t").cast("double")
    rank = F.col("_cum") - t + (t + 1) / 2
    sums = ranked.groupBy(key).agg(
        F.sum("_t").alias("n"), F.sum(F.col("_p") * rank).alias("v_plus"), F.sum((F.col("_t") - F.col("_p")) * rank).alias("v_minus"),
        F.sum(t * t * t - t).alias("tie_term"))
    out = sizes.join(sums, key, "left")
    enough = (F.col("n_units") >= 2) & F.col("n").isNotNull()
    stat = F.least("v_plus", "v_minus") if alternative == "two-sided" else F.col("v_plus")
    return out.select(key, "n_units", F.when(enough, stat).alias("v"),
                      tails.signed_rank(F.when(enough, F.col("v_plus")), F.col("n"), F.col("tie_term"), alternative).alias("p"))


def adjusted(tests: DataFrame, method: str, p: str = "p", within: Sequence[str] = ()) -> DataFrame:
    """Adds `p_adj`: Bonferroni, or the Benjamini-Hochberg step-up; a missing p stays missing."""
    if method == "none":
        return tests.withColumn("p_adj", F.col(p))
    keys = list(within) or ["_all"]
    tests = settled(tests)
    rows = tests if within else tests.withColumn("_all", F.lit(0))
    known = rows.filter(F.col(p).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    rows = rows.join(sizes, keys, "left")
    if method == "bonferroni":
        out = rows.withColumn("p_adj", F.least(F.col(p) * F.col("_m"), F.lit(1.0)))
        return out.drop("_m", "_all")
    # Equal p-values share the largest rank among them, which is what the running minimum would give them.
    ranks = average_ranks(known, keys, p).join(sizes, keys)
    step = ranks.withColumn("_a", F.col(p) * F.col("_m") / F.col("cum"))
    step = plan_layout(step, keys, p).mark(step)
    step = plain(running(step, keys, p, {"_adj": ("min", "_a")}, reverse=True))
    out = rows.join(step.select(*keys, p, "_adj"), [*keys, p], "left")
    return out.withColumn("p_adj", F.least("_adj", F.lit(1.0))).drop("_m", "_adj", "_all")


def stars(p: Column) -> Column:
    """Significance marks; empty when missing or not significant."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def pairwise(rows: DataFrame, metrics: Sequence[str], *, key: str = "grp", test: str = "mannwhitney",
             correction: str = "fdr_bh") -> DataFrame:
    """Every pair of groups compared on every metric, adjusted within the metric."""
    groups = rows.select(key).distinct()
    pairs = groups.select(F.col(key).alias("group_a")).join(groups.select(F.col(key).alias("group_b")),
                                                            F.col("group_a") < F.col("group_b"))
    sides = pairs.withColumn("_s", F.explode(F.array(
        F.struct(F.col("group_a").alias("g"), F.lit(True).alias("first")),
        F.struct(F.col("group_b").alias("g"), F.lit(False).alias("first")))))
    sides = sides.select("group_a", "group_b", F.col("_s.g").alias(key), F.col("_s.first").alias("_first"))
    long = rows.unpivot([key], list(metrics), "metric", "value").filter("value IS NOT NULL")
    # equal values of a group are counted before they meet the group's partners
    long = long.groupBy(key, "metric", "value").agg(F.count(F.lit(1)).alias("_times"))
    both = long.join(sides, key)
    out = two_samples(both, ["metric", "group_a", "group_b"], "value", F.col("_first"), F.col("_times"))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    if test == "ks":
        p = tails.ks_two_sample(F.when(enough, F.col("d")), n_a, n_b)
    else:
        p = tails.rank_sum(F.when(enough, F.col("u")), n_a, n_b, F.col("tie_term"))
    out = out.withColumn("p", p)
    return adjusted(out, correction, within=["metric"])


def paired_signed_rank(rows: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Signed-rank test on matched values held in two columns of one row."""
    return signed_rank(rows.withColumn("_diff", F.col(first) - F.col(second)), "_diff", 0.0, key)


# Resampling

def bootstrap_mean(rows: DataFrame, value: str, reps: int, seed: int, *, key: str = "grp", level: float = 0.95) -> DataFrame:
    """Percentile interval of the resampled mean per group.

    Every row counts a Poisson(1) number of times in every replicate, which drawing with replacement tends to. The
    number depends on seed, replicate and the row's rank in its group alone, so results are the same at every size and
    partitioning, and replicates are summed map-side without moving rows.
    """
    return _resampled(rows, {"m": F.col(value)}, lambda s: s[1] / s[0], reps, seed, key, level)


#: Rows of a key that are summed at once, and draws in memory at once.
CHUNK, DRAWS = 1 << 16, 1 << 15


def _poisson_counts(seed: int, reps: int, items: np.ndarray) -> np.ndarray:
    """How often each item (row) counts in each replicate (column): the numbers of `draw` against `POISSON_ONE`."""
    m, offset = np.uint64(DRAW_MODULUS), np.uint64(DRAW_OFFSET)
    bits, one = np.uint64(31), np.uint64(1)
    high = np.empty((len(items), reps), np.uint64)

    def fold(x: np.ndarray) -> np.ndarray:  # the modulus is 2^31 - 1; a number below 2^32 comes below 2^31 + 1
        h = np.right_shift(x, bits, out=high[:len(x)] if x.ndim == 2 else None)
        x &= m
        x += h
        return x

    def stir(x: np.ndarray) -> np.ndarray:
        x = fold(x)
        x *= x + offset
        return fold(fold(x))

    def least(p: float) -> int:  # the first draw that reaches a probability
        at = max(math.floor(p * DRAW_MODULUS) - 1, 0)
        return next(d for d in range(at, at + 4) if d / float(DRAW_MODULUS) >= p or d >= DRAW_MODULUS)

    a = stir((seed + np.arange(reps, dtype=np.int64) * 104_729).astype(np.uint64) % m)
    step, place = ((items.astype(np.uint64) * np.uint64(k) % m)[:, None] for k in (1_299_709, 1))
    x = stir(step + a)
    x += a
    x = stir(x)
    x += place
    x = stir(x)
    x += one  # m itself is zero
    u = (fold(x) - one).astype(np.int32)
    out = np.zeros(u.shape, np.int8)
    for p in POISSON_ONE:
        if (limit := least(p)) < DRAW_MODULUS:
            out += u >= np.int32(limit)
    return out


def _resampled(rows: DataFrame, terms: dict[str, Column], stat: Callable[[np.ndarray], np.ndarray], reps: int, seed: int, key: str,
               level: float) -> DataFrame:
    """Percentile limits per key of a statistic of the replicates' weighted sums (row 0: weights, then the terms).

    Rows are moved once, by key and chunk, and counted as one matrix product per key and block. A key of one chunk is
    finished there; a longer one leaves its sums, a row per replicate and chunk, to be added.
    """
    names = list(terms)
    data = rows.select(key, *[c.cast("double").alias(n) for n, c in terms.items()]).dropna(subset=names)
    data = row_index(lay_out(data, key, names[0]), key, names, "_i")
    data = plain(shift(data, key, "_i", {"_next": ("_i", 1)}))
    data = data.select(key, F.col("_i") - 1, F.col("_next").isNull(), *names).toDF(key, "_i", "_last", *names)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number is given, as the work is many times what the size of the rows suggests
    data = data.withColumn("_chunk", F.floor(F.col("_i") / CHUNK)).repartition(tasks, key, "_chunk").sortWithinPartitions(key, "_chunk", "_i").drop("_chunk")
    tails_ = ((1 - level) / 2, 1 - (1 - level) / 2)

    def limits(sums: np.ndarray) -> tuple[float | None, float | None]:
        with np.errstate(all="ignore"):
            found = stat(sums[:, sums[0] > 0])
        found = np.sort(found[~np.isnan(found)])
        if not len(found):
            return None, None
        at = [p * (len(found) - 1) for p in tails_]
        return tuple(float(found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)])) for x in at)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums, name, whole = max(1, DRAWS // reps), None, None, False

        def closed(complete: bool) -> pa.RecordBatch:
            low, high = limits(sums) if complete else (None, None)
            rest = pa.array([None if complete else sums.T.tolist()], pa.list_(pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays([name, pa.array([low], pa.float64()), pa.array([high], pa.float64()), rest], [key, "ci_low", "ci_high", "_sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            done: list[pa.RecordBatch] = []
            at = batch.column(1).to_numpy()
            last = batch.column(2).to_numpy(zero_copy_only=False)
            x = np.vstack([np.ones(len(at)), *(batch.column(i).to_numpy() for i in range(3, 3 + len(names)))])
            begins = at % CHUNK == 0
            for lo in range(0, len(at), block):
                hi = min(lo + block, len(at))
                times = _poisson_counts(seed, reps, at[lo:hi]).astype(np.float64)
                cuts = [lo, *(lo + 1 + np.flatnonzero(begins[lo + 1:hi])).tolist(), hi]
                for i, j in zip(cuts, cuts[1:]):
                    if begins[i]:
                        if sums is not None:
                            done.append(closed(whole))
                        sums, name, whole = np.zeros((len(x), reps)), batch.column(0).slice(i, 1), False
                        first = at[i] == 0
                    sums += x[:, i:j] @ times[i - lo:j - lo]
                    whole = first and bool(last[j - 1])
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if sums is not None:
            yield closed(whole)

    limits_type = [rows.schema[key], T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())]
    found = settled(data.mapInArrow(add, T.StructType([*limits_type, T.StructField("_sums", T.ArrayType(T.ArrayType(T.DoubleType())))])))
    parts = found.filter("_sums IS NOT NULL").select(key, F.posexplode("_sums").alias("_rep", "_s"))
    parts = parts.groupBy(key, "_rep").agg(F.array(*[F.sum(F.col("_s")[i]) for i in range(len(names) + 1)]).alias("_s")).select(key, "_s")

    def finish(table: pa.Table) -> pa.Table:  # a row per replicate
        low, high = limits(np.array(table.column(1).to_pylist()).T)
        return pa.table([table.column(0).slice(0, 1), pa.array([low], pa.float64()), pa.array([high], pa.float64())], names=[key, "ci_low", "ci_high"])

    long = parts.groupBy(key).applyInArrow(finish, T.StructType(limits_type))
    return found.filter("_sums IS NULL").drop("_sums").unionByName(long).filter("ci_low IS NOT NULL")


def poisson_sql(u: str) -> str:
    """The number of times a row counts, as SQL, from a draw."""
    return "(" + " + ".join(f"(({u}) / {float(DRAW_MODULUS)!r}::DOUBLE >= {p!r}::DOUBLE)::INT" for p in POISSON_ONE) + ")"


# Lag-1 autocorrelation

def interval_pairs(intervals: DataFrame, *, key: str = "recording", order: Sequence[str] = ("t", "event_id"),
                   value: str = "ioi_ms", detrend: str = "mean", min_intervals: int = 5) -> DataFrame:
    """Consecutive interval pairs (a, b) of recordings with enough intervals, after removing a mean or a line."""
    rows = intervals.filter(F.col(value).isNotNull())
    rows = running(rows, key, list(order), {"_i": ("sum", F.lit(1).cast("long"))}).withColumn("_i", F.col("_i") - 1)
    i, v = F.col("_i").cast("double"), F.col(value)
    fits = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_intervals"), F.avg(v).alias("_mean"),
                                 F.regr_slope(v, i).alias("_slope"), F.regr_intercept(v, i).alias("_icpt"))
    rows = rows.join(fits.filter(F.col("n_intervals") >= min_intervals), key)
    clean = {"none": v, "mean": v - F.col("_mean"), "linear": v - (F.col("_slope") * i + F.col("_icpt"))}[detrend]
    rows = rows.withColumn("a", clean)
    rows = shift(rows, key, "_i", {"b": ("a", 1)})
    return plain(rows.filter("b IS NOT NULL").select(key, "n_intervals", "a", "b", *[c for c in rows.columns if c == "_run"]))


def lag_one(pairs: DataFrame, key: str = "recording") -> DataFrame:
    """Pearson correlation of neighbouring intervals; null when one side does not vary."""
    flat = (F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0)
    return pairs.groupBy(key).agg(
        F.first("n_intervals").alias("n_intervals"), F.count(F.lit(1)).alias("n_pairs"),
        F.when(~flat, F.corr("a", "b")).alias("r_lag1"))


def fisher_interval(rows: DataFrame, level: float = 0.95) -> DataFrame:
    """Confidence limits by the z-transform; null below four pairs or for |r| = 1."""
    q = tails.normal_quantile(1 - (1 - level) / 2)
    r, n = F.col("r_lag1"), F.col("n_pairs")
    ok = (n >= 4) & (F.abs(r) < 1)
    z, half = F.atanh(r), F.lit(q) / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return rows.withColumns({"ci_low": F.when(ok, F.tanh(z - half)), "ci_high": F.when(ok, F.tanh(z + half))})


def bootstrap_lag_one(pairs: DataFrame, reps: int, seed: int, *, key: str = "recording", level: float = 0.95) -> DataFrame:
    """Percentile limits of the correlation when whole pairs are drawn with replacement."""
    a, b = F.col("a"), F.col("b")
    sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"),
                                   F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"))
    live = pairs.join(sizes.filter("_n >= 3 AND _sa > 0 AND _sb > 0"), key)
    # Correlation does not change under shift and scale; working on unit scale keeps the sums accurate.
    a, b = (F.col("a") - F.col("_ma")) / F.col("_sa"), (F.col("b") - F.col("_mb")) / F.col("_sb")

    def correlation(s: np.ndarray) -> np.ndarray:
        xa, xb, aa, bb, ab = s[1:] / s[0]
        va, vb = aa - xa * xa, bb - xb * xb
        return np.where((va > 1e-15) & (vb > 1e-15), (ab - xa * xb) / np.sqrt(va * vb), np.nan)

    return _resampled(live, {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}, correlation, reps, seed, key, level)


def pooled_lag_one(rows: DataFrame, *, key: str = "grp", level: float = 0.95) -> DataFrame:
    """Group mean of correlations on the z scale, weighted by max(pairs - 3, 1)."""
    q = tails.normal_quantile(1 - (1 - level) / 2)
    r = F.greatest(F.least(F.col("r_lag1"), F.lit(0.9999999)), F.lit(-0.9999999))
    w = F.greatest(F.col("n_pairs") - 3, F.lit(1)).cast("double")
    sums = rows.filter("r_lag1 IS NOT NULL").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.atanh(r) * w).alias("_z"), F.sum(w).alias("_w"))
    z, half = F.col("_z") / F.col("_w"), F.lit(q) / F.sqrt("_w")
    return sums.select(key, "n_files", F.tanh(z).alias("r_lag1_zmean"), F.tanh(z - half).alias("ci_low"),
                       F.tanh(z + half).alias("ci_high"))
