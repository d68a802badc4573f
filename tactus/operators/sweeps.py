"""Spacing rules tried at several settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.functions.numeric import tidy
from tactus.layout import RUN, exact_quantiles
from tactus.operators.intervals import with_ioi
from tactus.operators.metrics import onset_quality
from tactus.operators.thinning import spaced


def _at_thresholds(onsets: DataFrame, gaps: Sequence[float], name: str) -> DataFrame:
    """The spacing rule at every threshold at once: the threshold joins the key."""
    rows = onsets.withColumn(name, F.explode(F.array(*[F.lit(float(g)) for g in gaps])))
    rows = rows.withColumn("_gap", F.col(name))
    return spaced(rows, ["recording", name], "t", "_gap", ties=["event_id"]).drop("_gap")


def steps(start: float, stop: float, step: float) -> list[float]:
    n = int(round((stop - start) / step)) + 1
    return [start + i * step for i in range(n)]


def threshold_sweep(onsets: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """How many onsets survive each spacing threshold."""
    kept = _at_thresholds(onsets.select("recording", "event_id", "t", *_run(onsets)), steps(start, stop, step),
                          "threshold_sec")
    return kept.groupBy("recording", "threshold_sec").agg(F.count(F.lit(1)).alias("n_kept"))


def _run(df: DataFrame) -> list[str]:
    return [RUN] if RUN in df.columns else []


def tempo_adaptive(onsets: DataFrame, fraction: float, bpm: float | None = None, default_ms: float = 0.0) -> DataFrame:
    """Minimum interval as a share of the beat; the beat comes from the median interval unless given.

    Recordings with fewer than three onsets have no estimate and use the default interval.
    """
    if bpm:
        return spaced(onsets, "recording", "t", max(1, int(60_000 / bpm * fraction)) / 1000.0, ties=["event_id"])
    gaps = with_ioi(onsets)
    tempo = exact_quantiles(gaps, "recording", "ioi_ms", [0.5], "_q")
    enough = gaps.groupBy("recording").agg(F.count("ioi_ms").alias("_n")).filter("_n >= 2")
    median = F.col("_q")[0]
    ms = F.floor(F.lit(60_000.0) / (F.lit(60_000.0) / F.nullif(median, F.lit(0.0))) * fraction)
    limits = tempo.join(enough, "recording").filter(median > 0).select(
        "recording", (F.greatest(ms, F.lit(1)) / F.lit(1000.0)).alias("_g"))
    rows = onsets.join(limits, "recording", "left").withColumn(
        "_gap", F.coalesce("_g", F.lit(default_ms / 1000.0))).drop("_g")
    return spaced(rows, "recording", "t", "_gap", ties=["event_id"]).drop("_gap")


def sweep_summary(onsets: DataFrame, start: float, stop: float, step: float, *,
                  below_ms: Sequence[float] = (5.0, 10.0, 25.0)) -> DataFrame:
    """Interval spread and the threshold step that loses most onsets (the first such step)."""
    i = F.col("ioi_ms")
    gaps = with_ioi(onsets)
    stats = gaps.groupBy("recording").agg(
        F.count(F.lit(1)).alias("n_onsets"), tidy(F.min(i), 2).alias("min_ioi_ms"), tidy(F.avg(i), 2).alias("mean_ioi_ms"),
        *[tidy(F.lit(100.0) * F.count(F.when(i < b, 1)) / F.nullif(F.count(i), F.lit(0)), 1).alias(f"pct_below_{k}")
          for k, b in enumerate(below_ms, 1)])
    medians = exact_quantiles(gaps, "recording", "ioi_ms", [0.5], "_q")
    swept = threshold_sweep(onsets, start, stop, step)
    # One row per threshold and recording: counts side by side, then the first largest drop.
    at = steps(start, stop, step)
    wide = swept.groupBy("recording").agg(*[
        F.max(F.when(F.col("threshold_sec") == g, F.col("n_kept"))).alias(f"_c{k}") for k, g in enumerate(at)])
    drops = F.array(*[F.struct((F.col(f"_c{k}") - F.col(f"_c{k - 1}")).alias("diff"), F.lit(k).alias("k"),
                               F.lit(g).alias("sec")) for k, g in enumerate(at) if k])
    best = wide.withColumn("_best", F.array_min(drops))
    return stats.join(medians, "recording", "left").join(best, "recording").select(
        *stats.columns, tidy(F.col("_q")[0], 2).alias("median_ioi_ms"), F.col("_best.sec").alias("steepest_sec"),
        (-F.col("_best.diff")).alias("steepest_drop"))


def best_candidate(onsets: DataFrame, gaps: Sequence[float], *, close_ms: float) -> DataFrame:
    """Score each spacing candidate per recording and keep the best, the first on a tie."""
    rows = onsets.select("recording", "event_id", "t", *_run(onsets))
    tried = rows.withColumn("cand", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(float(g)).alias("gap")) for k, g in enumerate(gaps)])))
    tried = tried.select("recording", "event_id", "t", F.col("cand.k").alias("cand"), F.col("cand.gap").alias("_gap"),
                         *_run(onsets))
    kept = spaced(tried, ["recording", "cand"], "t", "_gap", ties=["event_id"]).drop("_gap")
    keyed = kept.withColumn("_key", F.struct("recording", "cand"))
    scored = onset_quality(keyed, close_ms=close_ms, key="_key")
    best = scored.groupBy(F.col("_key.recording").alias("recording")).agg(
        F.max_by(F.struct(F.col("_key.cand").alias("cand"), "score"), F.struct("score", -F.col("_key.cand"))).alias("_b"))
    return best.select("recording", F.col("_b.cand").alias("best_candidate"), F.col("_b.score").alias("score"))
