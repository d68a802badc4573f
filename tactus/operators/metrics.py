"""Per-recording summaries of intervals and pairs, one aggregation each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.numeric import ratio, unit_bin
from tactus.layout import exact_quantiles, shift
from tactus.operators.intervals import ORDER, with_ioi

BINS = 10


def bin_counts(r: Column, when: Column, bins: int = BINS) -> list[Column]:
    """Histogram counts as conditional sums, so the histogram needs no shuffle of its own."""
    return [F.sum(F.when(when & (unit_bin(r, bins) == i), 1).otherwise(0)).alias(f"_b{i}") for i in range(bins)]


def entropy(counts: Sequence[Column], base: float | None = None) -> Column:
    """Shannon entropy of counts; natural logarithm unless a base is given."""
    total = sum(counts[1:], counts[0]).cast("double")
    weigh = lambda c: F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))
    nats = F.log(F.nullif(total, F.lit(0.0))) - sum((weigh(c) for c in counts[1:]), weigh(counts[0])) / F.nullif(total, F.lit(0.0))
    return nats if base is None else nats / F.log(F.lit(float(base)))


def rhythm_metrics(pairs: DataFrame, *, key: str | Sequence[str] = "recording", zero: float | None = 0.0) -> DataFrame:
    """Metrics over all pairs and over the stable ones, in one pass over the pair table.

    The interval sequence is every first interval plus the second interval of the last pair, which is why the
    pair order is needed. `zero` is the CV reported for a zero mean (0 or null).
    """
    key = [key] if isinstance(key, str) else list(key)
    last = F.max_by("interval_2_ms", "dyad_index")
    r, one, two, stable = F.col("r_k"), F.col("interval_1_ms"), F.col("interval_2_ms"), F.col("stable")
    n_i = F.col("n_dyads") + 1
    sums = pairs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_dyads"), F.avg("cycle_ms").alias("avg_cycle_ms"),
        (F.avg(F.abs(r - 0.5)) * 400).alias("npvi"), F.stddev_pop(r).alias("rk_std"),
        F.avg(one).alias("_m"), F.var_pop(one).alias("_v"), last.alias("_last"),
        *bin_counts(r, F.lit(True)),
        F.sum(stable.cast("long")).alias("stable_n"),
        (F.avg(F.when(stable, F.abs(r - 0.5))) * 400).alias("stable_npvi"),
        F.stddev_pop(F.when(stable, r)).alias("stable_rk_std"),
        F.avg(F.when(stable, one)).alias("_m1"), F.avg(F.when(stable, two)).alias("_m2"),
        F.var_pop(F.when(stable, one)).alias("_v1"), F.var_pop(F.when(stable, two)).alias("_v2"),
        *[c.alias(f"_s{i}") for i, c in enumerate(bin_counts(r, stable))])
    # Append the last second interval to mean and variance of the first intervals.
    n = F.col("n_dyads")
    mean = (F.col("_m") * n + F.col("_last")) / n_i
    var = (F.col("_v") * n + (F.col("_last") - F.col("_m")) * (F.col("_last") - mean)) / n_i
    s_mean = (F.col("_m1") + F.col("_m2")) / 2
    s_var = (F.col("_v1") + F.col("_v2")) / 2 + F.pow((F.col("_m1") - F.col("_m2")) / 2, 2)
    none = F.lit(zero).cast("double")
    return sums.select(
        *key, (n + 2).alias("n_onsets"), "avg_cycle_ms", "npvi",
        F.when(mean > 0, F.sqrt(F.greatest(var, F.lit(0.0))) / F.nullif(mean, F.lit(0.0))).otherwise(none).alias("cv"),
        "rk_std", entropy([F.col(f"_b{i}") for i in range(BINS)]).alias("rk_entropy"),
        "stable_n", "stable_npvi",
        F.when(F.col("stable_n") > 0, F.when(s_mean > 0, F.sqrt(s_var) / F.nullif(s_mean, F.lit(0.0))).otherwise(none))
        .alias("stable_cv"), "stable_rk_std",
        F.when(F.col("stable_n") > 0, entropy([F.col(f"_s{i}") for i in range(BINS)])).alias("stable_entropy"))


def speech_metrics(onsets: DataFrame, *, pause_ms: float = 250.0, key: str = "recording",
                   order: Sequence[str] = ORDER) -> DataFrame:
    """Rate, variability and pause figures from intervals; null with fewer than two intervals."""
    rows = with_ioi(onsets, key=key, order=order)
    rows = shift(rows, key, order, {"_prev": ("ioi_ms", -1)})
    return speech_metrics_of_intervals(rows, pause_ms=pause_ms, key=key)


def speech_metrics_of_intervals(rows: DataFrame, *, pause_ms: float = 250.0, key: str = "recording") -> DataFrame:
    """As above for rows that carry `ioi_ms` and the previous interval `_prev`."""
    i, p = F.col("ioi_ms"), F.col("_prev")
    diff, total = F.abs(i - p), i + p
    speech = F.when(i <= pause_ms, i)
    pause = F.when(i > pause_ms, i)
    agg = rows.filter(i.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(i).alias("mean_ioi_ms"), F.stddev_pop(i).alias("std_ioi_ms"),
        F.avg(diff).alias("pvi_raw_ms"),
        (F.avg(F.when(p.isNotNull(), F.when(total > 0, diff / F.nullif(total / 2, F.lit(0.0))).otherwise(0.0))) * 100)
        .alias("npvi_pct"),
        F.count(pause).alias("pause_count"), F.coalesce(F.avg(pause), F.lit(0.0)).alias("mean_pause_ms"),
        F.avg(speech).alias("_sp"), F.coalesce(F.sum(speech), F.lit(0.0)).alias("_sps"), F.sum(i).alias("_all"))
    mean = F.col("mean_ioi_ms")
    rate = F.when(mean > 0, 1000 / F.nullif(mean, F.lit(0.0))).otherwise(0.0)
    cols = {
        "speech_rate": F.round(rate, 3), "mean_ioi_ms": F.round(mean, 2), "std_ioi_ms": F.round("std_ioi_ms", 2),
        "pvi_raw_ms": F.round("pvi_raw_ms", 2), "npvi_pct": F.round("npvi_pct", 2),
        "varco_pct": F.round(F.when(mean > 0, 100 * F.col("std_ioi_ms") / F.nullif(mean, F.lit(0.0))).otherwise(0.0), 2),
        "articulation_rate": F.round(F.coalesce(1000 / F.nullif(F.col("_sp"), F.lit(0.0)), rate), 3),
        "pause_count": F.col("pause_count"), "mean_pause_ms": F.round("mean_pause_ms", 2),
        "phonation_ratio": F.round(F.when(F.col("_all") > 0, F.col("_sps") / F.nullif(F.col("_all"), F.lit(0.0)))
                                   .otherwise(0.0), 4),
    }
    enough = F.col("_n") >= 2
    return agg.select(key, *[F.when(enough, c).alias(n) for n, c in cols.items()])


def label_interval_metrics(intervals: DataFrame, *, key: str = "recording", order: str = "seq") -> DataFrame:
    """%V, deltas and pairwise variability of intervals flagged `is_vowel`; neighbours are taken within a class."""
    rows = intervals.withColumn("dur", F.col("end") - F.col("start"))
    rows = shift(rows, [key, "is_vowel"], order, {"_prev": ("dur", -1)})
    vowel, d, p = F.col("is_vowel"), F.col("dur"), F.col("_prev")
    step = F.abs(d - p)
    return rows.groupBy(key).agg(
        ratio(F.sum(F.when(vowel, d)) * 100, F.sum(d)).alias("percent_v"),
        (F.stddev_pop(F.when(vowel, d)) * 1000).alias("delta_v_ms"),
        (F.stddev_pop(F.when(~vowel, d)) * 1000).alias("delta_c_ms"),
        (F.avg(F.when(~vowel, step)) * 1000).alias("rpvi_c_ms"),
        (F.avg(F.when(vowel & p.isNotNull(), F.when(d + p > 0, step / F.nullif((d + p) / 2, F.lit(0.0)))
                      .otherwise(0.0))) * 100).alias("npvi_v"))


def median_tempo(onsets: DataFrame, *, key: str = "recording", order: Sequence[str] = ORDER) -> DataFrame:
    """60 / median positive interval, in beats per minute."""
    gaps = with_ioi(onsets, key=key, order=order).filter(F.col("ioi_ms") > 0)
    return exact_quantiles(gaps, key, "ioi_ms", [0.5], "q").select(
        key, (F.lit(60_000.0) / F.col("q")[0]).alias("bpm"))


def onset_quality(onsets: DataFrame, *, close_ms: float = 15.0, key: str = "recording",
                  order: Sequence[str] = ORDER) -> DataFrame:
    """Count, spacing, regularity around the median and a 0-100 score; zeros with fewer than two onsets."""
    rows = with_ioi(onsets, key=key, order=order)
    medians = exact_quantiles(rows, key, "ioi_ms", [0.5], "_q")
    i = F.col("ioi_ms")
    first = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_onsets"), F.avg(i).alias("_mean"), F.stddev_pop(i).alias("_std"),
        F.min(i).alias("_min"), F.count(F.when(i < close_ms, 1)).alias("_close"))
    near = rows.join(medians, key).filter((i > F.col("_q")[0] * 0.25) & (i < F.col("_q")[0] * 4)).groupBy(key).agg(
        F.count(F.lit(1)).alias("_regular"))
    rows = first.join(near, key, "left")
    n = F.col("n_onsets")
    cv = F.col("_std") / F.greatest(F.col("_mean"), F.lit(1e-10))
    score = (F.lit(100.0) - F.greatest(10 - n, F.lit(0)) * 3 - F.col("_close") * 5
             - F.greatest(cv - 1.5, F.lit(0.0)) * 10)
    score = F.greatest(score, F.lit(0.0))
    score = F.when(n.between(5, 500), F.least(score + 10, F.lit(100.0))).otherwise(score)
    score = F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0))
    enough = n >= 2
    num = lambda c, d: F.round(F.when(enough, c).otherwise(F.lit(0.0)), d)
    return rows.select(
        key, "n_onsets", num(F.col("_mean"), 2).alias("mean_ioi_ms"), num(cv, 3).alias("ioi_cv"),
        num(F.col("_min"), 2).alias("min_ioi_ms"),
        F.when(enough, F.col("_close")).otherwise(F.lit(0)).cast("long").alias("close_pairs"),
        num(F.coalesce(F.col("_regular"), F.lit(0)) / (n - 1 + F.when(enough, 0).otherwise(1)), 3).alias("regularity"),
        num(score, 1).alias("score"))
