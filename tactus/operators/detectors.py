"""Onset detectors on frame tables, under names, all of the form DataFrame -> DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.numeric import MEL_BREAK_HZ, MEL_LOG_FACTOR, MEL_LOG_STEPS, MEL_STEP_HZ
from tactus.layout import RUN, framed, running, shift
from tactus.operators.frames import KEY, selection_onsets
from tactus.operators.thinning import FOLD_ROWS, parted_by_dips, spaced
from tactus.session import settled

Detector = Callable[..., DataFrame]
DETECTORS: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Register a detector under a name."""
    def add(fn: Detector) -> Detector:
        DETECTORS[name] = fn
        return fn
    return add


def detect_onsets(method: str, frames: DataFrame, **settings) -> DataFrame:
    if method not in DETECTORS:
        raise ValueError(f"unknown onset method {method!r}; known: {', '.join(sorted(DETECTORS))}")
    return DETECTORS[method](frames, **settings)


def rising_edges(frames: DataFrame, above: Column) -> DataFrame:
    """Frames where the condition starts to hold; the first frame of a recording never fires."""
    rows = shift(frames.withColumn("_a", F.coalesce(above, F.lit(False))), KEY, "frame", {"_pa": ("_a", -1)})
    return rows.filter(F.col("_a") & ~F.col("_pa")).drop("_a", "_pa")


def _enough(frames: DataFrame, least: int = 4) -> DataFrame:
    dense = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_frames")).filter(F.col("n_frames") >= least)
    return frames.join(dense, KEY)


def odd(k: int) -> int:
    return max(3, k if k % 2 else k + 1)


def padded_median(window: Column, kernel: int) -> Column:
    """Median of a centred window of non-negative values where missing neighbours count as zero."""
    at = F.lit((kernel + 1) // 2) - (F.lit(kernel) - F.size(window))
    return F.when(at >= 1, F.element_at(F.sort_array(window), F.greatest(at, F.lit(1)))).otherwise(F.lit(0.0))


@detector("moving_median")
def moving_median(frames: DataFrame, *, kernel: int = 5, scale: float = 1.1) -> DataFrame:
    """Level above a multiple of its running median."""
    k = odd(kernel)
    rows = framed(_enough(frames), KEY, "frame", {"_w": lambda w: F.collect_list("rms").over(w)}, k // 2, k // 2)
    return rising_edges(rows, F.col("rms") > scale * padded_median(F.col("_w"), k)).drop("_w")


@detector("cfar")
def cfar(frames: DataFrame, *, guard: int = 1, training: int = 3, factor: float = 1.0) -> DataFrame:
    """Level above mean + factor * deviation of the training cells on both sides of a guard band."""
    guard, training = max(guard, 1), max(training, 1)
    margin = guard + training
    cells = lambda side: {f"_n{side}": lambda w: F.count("rms").over(w), f"_s{side}": lambda w: F.sum("rms").over(w),
                          f"_q{side}": lambda w: F.sum(F.col("rms") * F.col("rms")).over(w)}
    rows = framed(_enough(frames), KEY, "frame", cells("l"), margin, -(guard + 1))
    rows = framed(rows, KEY, "frame", cells("t"), -(guard + 1), margin)
    n = 2.0 * training
    mean = (F.col("_sl") + F.col("_st")) / n
    var = F.greatest((F.col("_ql") + F.col("_qt")) / n - mean * mean, F.lit(0.0))
    full = (F.col("_nl") == training) & (F.col("_nt") == training)
    above = full & (F.col("rms") > mean + factor * F.sqrt(var))
    return rising_edges(rows, above).drop("_nl", "_sl", "_ql", "_nt", "_st", "_qt")


def mel_edges(low_hz: float, high_hz: float, bands: int) -> list[float]:
    """Band edges evenly spaced on the Slaney mel scale."""
    knee, step = MEL_BREAK_HZ / MEL_STEP_HZ, math.log(MEL_LOG_FACTOR) / MEL_LOG_STEPS
    mel = lambda f: f / MEL_STEP_HZ if f < MEL_BREAK_HZ else knee + math.log(f / MEL_BREAK_HZ) / step
    hz = lambda m: m * MEL_STEP_HZ if m < knee else MEL_BREAK_HZ * math.exp(step * (m - knee))
    a, b = mel(low_hz), mel(high_hz)
    return [hz(a + (b - a) * i / bands) for i in range(bands + 1)]


@detector("per_band")
def per_band(frames: DataFrame, *, bin_hz: float = 100.0, n_bins: int = 64, low_hz: float = 0.0, high_hz: float = 6400.0,
             bands: int = 6, kernel: int = 5, scale: float = 1.2, min_bands: int = 2) -> DataFrame:
    """Frames where enough mel bands show a rise above a multiple of their running median."""
    edges = mel_edges(low_hz, high_hz, bands)
    groups = [[i for i in range(n_bins) if lo <= i * bin_hz < hi] for lo, hi in zip(edges, edges[1:], strict=False)]
    groups = [g for g in groups if g]
    energy = F.array(*[F.aggregate(F.slice("bins", g[0] + 1, len(g)), F.lit(0.0), lambda s, v: s + v) for g in groups])
    rows = shift(frames.withColumn("_e", energy), KEY, "frame", {"_pe": ("_e", -1)})
    flux = F.when(F.col("_pe").isNull(), F.transform("_e", lambda v: F.lit(0.0))).otherwise(
        F.zip_with("_e", "_pe", lambda a, b: F.greatest(a - b, F.lit(0.0))))
    k = odd(kernel)
    rows = framed(rows.withColumn("_f", flux), KEY, "frame", {"_w": lambda w: F.collect_list("_f").over(w)}, k // 2, k // 2)

    def vote(b: int) -> Column:
        column = F.transform("_w", lambda v: F.element_at(v, b + 1))
        return (F.element_at("_f", b + 1) > scale * padded_median(column, k)).cast("int")

    votes = [vote(b) for b in range(len(groups))]
    total = sum(votes[1:], votes[0])
    return rising_edges(rows.withColumn("votes", total), F.col("votes") >= min_bands).drop("_e", "_pe", "_f", "_w")


@detector("baseline_crossing")
def baseline_crossing(frames: DataFrame, *, narrow: int = 1, wide: int = 5) -> DataFrame:
    """Smoothed level crossing its baseline upwards; both are running means unless given as columns."""
    rows = _enough(frames)
    if "smooth" not in frames.columns:
        rows = framed(rows, KEY, "frame", {"smooth": lambda w: F.avg("rms").over(w)}, narrow, narrow)
    if "baseline" not in frames.columns:
        rows = framed(rows, KEY, "frame", {"baseline": lambda w: F.avg("rms").over(w)}, wide, wide)
    rows = rows.withColumn("_r", F.col("smooth") - F.col("baseline"))
    rows = shift(rows, KEY, "frame", {"_pr": ("_r", -1)})
    return rows.filter((F.col("_r") > 0) & (F.col("_pr") <= 0)).drop("_r", "_pr")


@detector("intensity_nuclei")
def intensity_nuclei(frames: DataFrame, *, threshold_db: float = -10.0, min_dip_db: float = 2.0, min_pause: float = 0.1,
                     level: str = "level_db", voiced: str | None = "voiced", fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Loud local maxima separated by dips of at least `min_dip_db` on both sides, voiced, with a minimum spacing.

    Where the dip is too small the louder maximum stays. A valley so deep that every loud maximum clears it
    divides the sequence. Short stretches between such valleys fold inside the JVM; where one is long, the maxima are
    scanned in order per run with a carried row.
    """
    rows = shift(frames, KEY, "frame", {"_p": (level, -1), "_n": (level, 1)})
    tops = rows.groupBy(KEY).agg((F.max(level) + threshold_db).alias("_floor"))
    rows = rows.join(tops, KEY)
    v = F.col(level)
    peak = (v > F.col("_p")) & (v >= F.col("_n")) & (v >= F.col("_floor"))
    rows = running(rows.withColumn("_peak", F.coalesce(peak, F.lit(False))), KEY, "frame", {"_seg": ("sum", F.col("_peak").cast("long"))})
    # Lowest level since the previous maximum, both ends included.
    ends = F.when(F.col("_peak"), F.col("_seg") - 1).otherwise(F.col("_seg"))
    valleys = rows.withColumn("_seg", ends).groupBy(KEY, "_seg").agg(F.min(level).alias("_valley"))
    peaks = rows.filter("_peak").withColumn("_seg", F.col("_seg") - 1).join(valleys, [KEY, "_seg"])
    deep = (F.col("_seg") == 0) | (F.col("_valley") <= F.col("_floor") - min_dip_db)
    keep = [KEY, "frame", level, *[c for c in frames.columns if c not in (KEY, "frame", level)]]
    peaks = settled(peaks.withColumn("_deep", deep).select(*keep, "_valley", "_deep"))
    islands = running(peaks.withColumn("_cut", F.col("_deep").cast("long")), KEY, "frame", {"_island": ("sum", "_cut")})
    largest = islands.groupBy(KEY, "_island").count().agg(F.max("count")).first()[0] or 0
    if largest <= fold_rows:
        nuclei = _folded_nuclei(islands, [c for c in keep if c not in (KEY, "frame", level, RUN)], level, min_dip_db)
    else:
        nuclei = parted_by_dips(peaks, KEY, "frame", level, "_deep", min_dip_db)
    nuclei = nuclei.drop("_valley", "_deep")
    if voiced:
        nuclei = nuclei.filter(F.col(voiced))
    return spaced(nuclei, KEY, "t", min_pause, strength=level, ties=["frame"]) if min_pause > 0 else nuclei


def _folded_nuclei(islands: DataFrame, rest: list[str], level: str, min_dip_db: float) -> DataFrame:
    """The dip rule folded over each stretch between deep valleys."""
    packed = islands.groupBy(KEY, "_island").agg(F.sort_array(F.collect_list(
        F.struct("frame", level, "_valley", *rest))).alias("_rows"))
    start = F.struct(F.slice("_rows", 1, 1).alias("kept"), F.lit(float("inf")).alias("low"))

    def step(state: Column, row: Column) -> Column:
        kept, last = state["kept"], F.element_at(state["kept"], -1)
        low = F.least(state["low"], row["_valley"])
        apart = (last[level] - low >= min_dip_db) & (row[level] - low >= min_dip_db)
        louder = row[level] > last[level]
        inf = F.lit(float("inf"))
        return F.struct(
            F.when(apart, F.concat(kept, F.array(row))).when(louder, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(row)))
            .otherwise(kept).alias("kept"), F.when(apart | louder, inf).otherwise(low).alias("low"))

    merged = F.aggregate(F.slice("_rows", 2, F.size("_rows")), start, step, lambda s: s["kept"])
    return packed.select(KEY, F.explode(merged).alias("_k")).select(KEY, "_k.*")


@detector("volume_delta")
def volume_delta(frames: DataFrame, *, hop: float = 0.05, **settings) -> DataFrame:
    return selection_onsets(frames, hop, method="volume_delta", **settings)


@detector("spectral_flux")
def spectral_flux(frames: DataFrame, *, hop: float = 0.05, **settings) -> DataFrame:
    return selection_onsets(frames, hop, method="spectral_flux", **settings)


