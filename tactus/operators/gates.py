"""Gates that keep or drop detected onsets by the frames around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions.numeric import interpolate, ratio
from tactus.layout import Layout, around, shift, within_spans
from tactus.operators.matching import frame_at
from tactus.operators.profiles import BIN_HZ, region_features
from tactus.operators.thinning import spaced

KEY = "recording"
ID = "event_id"
# Deviation range in percent and the thresholds at its two ends.
DEVIATION = (5.0, 100.0)
SPECTRAL_LIMIT = (0.55, 0.20)
VARIABLE_LIMIT = (0.72, 0.52)


def amplitude_gate(onsets: DataFrame, frames: DataFrame, fraction: float, *, layout: Layout | None = None) -> DataFrame:
    """Keep onsets whose nearest frame has at least the given fraction of the recording's peak level."""
    peaks = frames.groupBy(KEY).agg((F.max("rms") * fraction).alias("_limit"))
    at = frame_at(onsets, frames, tie="earlier", layout=layout)
    rows = at.join(frames.select(KEY, "frame", F.col("rms").alias("_rms")), [KEY, "frame"]).join(peaks, KEY)
    return rows.filter(F.col("_rms") >= F.col("_limit")).drop("_rms", "_limit")


def local_slope(onsets: DataFrame, frames: DataFrame, half: float, value: str = "rms") -> DataFrame:
    """Largest rise between frames within `half` seconds of each onset; 0 without frames."""
    rises = shift(frames, KEY, "frame", {"_pv": (value, -1)}).select(KEY, F.col("t").alias("_ft"), (F.col(value) - F.col("_pv")).alias("_d"))
    pairs = around(onsets.select(KEY, ID, "t"), rises.filter("_d IS NOT NULL"), KEY, "t", "_ft", half)
    best = pairs.groupBy(KEY, ID).agg(F.max("_d").alias("slope"))
    return onsets.join(best, [KEY, ID], "left").withColumn("slope", F.coalesce("slope", F.lit(0.0)))


def sharpness_gate(onsets: DataFrame, frames: DataFrame, fraction: float, half: float) -> DataFrame:
    """Keep onsets with at least the given fraction of the recording's largest attack slope; all if that is not positive."""
    rows = local_slope(onsets, frames, half)
    peaks = rows.groupBy(KEY).agg(F.max("slope").alias("_peak"))
    return rows.join(peaks, KEY).filter((F.col("_peak") <= 0) | (F.col("slope") >= F.col("_peak") * fraction)).drop("_peak")


def band_edges(n_bins: int, bands: int) -> list[int]:
    return [int(n_bins * i / bands) for i in range(bands + 1)]


def broadband_gate(onsets: DataFrame, frames: DataFrame, n_bins: int, *, min_bands: int, bands: int = 6, threshold: float = 0.15,
                   layout: Layout | None = None) -> DataFrame:
    """Keep onsets at whose frame enough bands reach a share of their own peak energy."""
    edges = band_edges(n_bins, bands)
    energy = [F.aggregate(F.slice("bins", a + 1, b - a), F.lit(0.0), lambda s, v: s + v * v) for a, b in zip(edges, edges[1:], strict=False)]
    rows = frames.select(KEY, "frame", *[e.alias(f"_e{i}") for i, e in enumerate(energy)])
    peaks = rows.groupBy(KEY).agg(*[F.max(f"_e{i}").alias(f"_p{i}") for i in range(bands)])
    peak = lambda i: F.when(F.col(f"_p{i}") == 0, 1.0).otherwise(F.col(f"_p{i}"))
    active = [(F.col(f"_e{i}") >= threshold * peak(i)).cast("int") for i in range(bands)]
    at = frame_at(onsets, frames, layout=layout).join(rows, [KEY, "frame"]).join(peaks, KEY)
    return at.withColumn("active_bands", sum(active[1:], active[0])).filter(F.col("active_bands") >= min_bands).drop(
        *[f"_{c}{i}" for c in "ep" for i in range(bands)])


def frequency_gate(onsets: DataFrame, regions: DataFrame, frames: DataFrame, *, threshold: float, half: float,
                   width: float = 1.0) -> DataFrame:
    """Drop onsets matched by an unwanted band; if wanted bands exist, keep only onsets matched by one.

    A region matches an onset inside its time span when its band holds at least `threshold` of the local energy.
    Onsets without local frames stay. Silent surroundings drop the onset.
    """
    power = F.transform("bins", lambda v: v * v)
    local = around(onsets.select(KEY, ID, "t"), frames.select(KEY, F.col("t").alias("_ft"), power.alias("_p")), KEY, "t", "_ft", half)
    long = local.select(KEY, ID, F.posexplode("_p").alias("bin", "p")).groupBy(KEY, ID, "bin").agg(F.avg("p").alias("p"))
    totals = long.groupBy(KEY, ID).agg(F.sum("p").alias("_total"))
    bands = regions.filter("f_low IS NOT NULL AND f_high IS NOT NULL AND f_high > f_low").select(
        KEY, "t_start", "t_end", "f_low", "f_high", "polarity")
    inside = within_spans(bands, onsets.select(KEY, ID, F.col("t").alias("_ot")), KEY, "t_start", "t_end", "_ot", width)
    inside = inside.withColumn("_pair", F.struct("t_start", "t_end", "f_low", "f_high", "polarity"))
    f = F.col("bin") * BIN_HZ
    shares = inside.join(long, [KEY, ID]).groupBy(KEY, ID, "_pair").agg(
        F.sum(F.when(f.between(F.col("f_low"), F.col("f_high")), F.col("p")).otherwise(0.0)).alias("_in"))
    shares = shares.join(totals, [KEY, ID]).withColumn("_hit", ratio(F.col("_in"), F.col("_total")) >= threshold)
    hits = shares.groupBy(KEY, ID).agg(*[
        F.max(F.col("_hit") & (F.col("_pair.polarity") == p)).alias(f"_{p}") for p in ("positive", "negative")])
    wanted = bands.groupBy(KEY).agg(F.max(F.col("polarity") == "positive").alias("_wanted"))
    rows = onsets.join(totals, [KEY, ID], "left").join(hits, [KEY, ID], "left").join(wanted, KEY, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    keep = (F.col("_wanted").isNull() | F.col("_total").isNull()
            | ((F.col("_total") > 0) & ~yes("_negative") & (~F.col("_wanted") | yes("_positive"))))
    return rows.filter(keep).drop("_total", "_positive", "_negative", "_wanted")


def spectral_similarity(onsets: DataFrame, template: DataFrame, frames: DataFrame, half: float) -> DataFrame:
    """Cosine of the local mean spectrum and the recording's template; null when undecidable, 0 for silence."""
    local = around(onsets.select(KEY, ID, "t"), frames.select(KEY, F.col("t").alias("_ft"), "bins"), KEY, "t", "_ft", half)
    means = local.select(KEY, ID, F.posexplode("bins").alias("bin", "mag")).groupBy(KEY, ID, "bin").agg(F.avg("mag").alias("_m"))
    sums = means.join(template, [KEY, "bin"]).groupBy(KEY, ID).agg(
        F.sum(F.col("_m") * F.col("ref")).alias("_dot"), F.sum(F.col("_m") * F.col("_m")).alias("_sq"), F.sum(F.col("ref") * F.col("ref")).alias("_rr"))
    sums = sums.filter("_rr > 0").select(KEY, ID, F.when(F.col("_sq") > 0, F.col("_dot") / F.nullif(F.sqrt("_sq"), F.lit(0.0)))
                                         .otherwise(F.lit(0.0)).alias("similarity"))
    return onsets.join(sums, [KEY, ID], "left")


def spectral_gate(onsets: DataFrame, template: DataFrame, frames: DataFrame, half: float, threshold: float = 0.3) -> DataFrame:
    """Keep onsets similar enough to the template, and those that cannot be decided."""
    rows = spectral_similarity(onsets, template, frames, half)
    return rows.filter(F.col("similarity").isNull() | (F.col("similarity") >= threshold))


def local_features(onsets: DataFrame, frames: DataFrame, half: float, f_low: float, f_high: float) -> DataFrame:
    """Region features of the window around each onset; null where the window holds no frame."""
    spans = onsets.select(KEY, F.col(ID).alias("region_id"), F.greatest(F.col("t") - half, F.lit(0.0)).alias("t_start"),
                          (F.col("t") + half).alias("t_end"), F.lit(f_low).alias("f_low"), F.lit(f_high).alias("f_high"))
    found = region_features(spans, frames, width=2 * half).withColumnRenamed("region_id", ID)
    return onsets.join(found, [KEY, ID], "left")


Check = tuple[float, float, float]


def checks_from(reference: Mapping[str, float | None], config: Mapping[str, Mapping]) -> dict[str, Check]:
    """Reference, lower and upper bound of each enabled feature; duration is never checked."""
    out = {}
    for name, cfg in config.items():
        ref = reference.get(name)
        if name == "duration_s" or not cfg.get("enabled") or ref is None:
            continue
        spread = cfg.get("deviation_pct", 30)
        out[name] = (float(ref), float(cfg.get("lower_bound", ref * (1 - cfg.get("lower_pct", spread) / 100))),
                     float(cfg.get("upper_bound", ref * (1 + cfg.get("upper_pct", spread) / 100))))
    return out


def bounds_gate(candidates: DataFrame, checks: Mapping[str, Check]) -> DataFrame:
    """Keep rows whose every checked feature is present and within its bounds."""
    rows = candidates
    for name, (_, low, high) in checks.items():
        rows = rows.filter(F.coalesce(F.col(name).between(low, high), F.lit(False)))
    return rows


def match_score(candidates: DataFrame, checks: Mapping[str, Check]) -> DataFrame:
    """Mean closeness to the reference features and the names of those out of bounds."""
    if not checks:
        return candidates.withColumns({"score": F.lit(1.0), "failed": F.array().cast("array<string>")})
    parts, failed = [], []
    for name, (ref, low, high) in checks.items():
        tolerance = max(abs(ref - low), abs(high - ref), abs(ref) * 0.05, 1e-6)
        value = F.col(name)
        parts.append(F.coalesce(F.greatest(F.lit(0.0), 1 - 0.4 * F.abs(value - ref) / tolerance), F.lit(0.0)))
        failed.append(F.when(~F.coalesce(value.between(low, high), F.lit(False)), name))
    return candidates.withColumns({"score": sum(parts[1:], parts[0]) / len(parts), "failed": F.array_compact(F.array(*failed))})


def threshold_for(deviations: Sequence[float], ends: tuple[float, float]) -> float:
    """Threshold from the mean allowed deviation, interpolated between the two ends."""
    mean = sum(deviations) / len(deviations) if deviations else 30.0
    share = (min(max(mean, DEVIATION[0]), DEVIATION[1]) - DEVIATION[0]) / (DEVIATION[1] - DEVIATION[0])
    return ends[0] + share * (ends[1] - ends[0])


def threshold_column(deviation: Column, ends: tuple[float, float]) -> Column:
    return interpolate(deviation, *DEVIATION, *ends)


def probe_times(regions: DataFrame, fractions: Sequence[float] = (0.05, 0.25, 0.5, 0.75)) -> DataFrame:
    """Times at fixed shares of each region, more than 1 ms apart; the start for an empty region."""
    length = F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))
    times = [F.least(F.greatest(F.col("t_start") + length * f, F.col("t_start")), F.col("t_end")) for f in fractions]
    wide = F.array(*times)
    kept = F.aggregate(F.slice(wide, 2, len(times)), F.slice(wide, 1, 1), lambda acc, x: F.when(
        F.abs(x - F.element_at(acc, -1)) > 0.001, F.concat(acc, F.array(x))).otherwise(acc))
    out = F.when(length <= 0, F.array(F.col("t_start"))).otherwise(kept)
    return regions.select(KEY, "region_id", F.posexplode(out).alias("probe", "t"))


def diagnosed(scored: DataFrame, spectral_limit: float, variable_limit: float) -> DataFrame:
    """Both tests and their combined ratio for rows with `similarity` (null = undecidable) and `score`."""
    spec = F.coalesce(F.col("similarity") / max(spectral_limit, 1e-6), F.lit(1.0))
    passed = F.coalesce(F.col("similarity") >= spectral_limit, F.lit(True)) & (F.col("score") >= variable_limit)
    return scored.withColumns({"passed": passed, "combined": (spec + F.col("score") / max(variable_limit, 1e-6)) / 2})


def recovered(diagnoses: DataFrame, *, margin: float = 0.05) -> DataFrame:
    """Per region: best ratio, whether any probe passed, and the earliest passing time close to the best one."""
    by = [KEY, "region_id"]
    best = diagnoses.groupBy(*by).agg(F.max("combined").alias("best_ratio"), F.max("passed").alias("passed"),
                                      F.max(F.when(F.col("passed"), F.col("combined"))).alias("_top"))
    near = diagnoses.join(best.select(*by, "_top"), by).filter(F.col("passed") & (F.col("combined") >= F.col("_top") - margin))
    times = near.groupBy(*by).agg(F.min("t").alias("recovered_t"))
    return best.drop("_top").join(times, by, "left")


def candidate_peaks(regions: DataFrame, frames: DataFrame, *, most: int = 6, width: float = 1.0) -> DataFrame:
    """The strongest local maxima of `strength` in each region, at most `most`, ties by time, 1 ms apart."""
    by = [KEY, "region_id"]
    pairs = within_spans(regions.select(*by, "t_start", "t_end"), frames.select(KEY, "frame", "t", "strength"), KEY, "t_start", "t_end", "t", width)
    rows = shift(pairs, by, "frame", {"_p": ("strength", -1), "_n": ("strength", 1)})
    s = F.col("strength")
    peaks = rows.filter((F.col("_p").isNull() | (s >= F.col("_p"))) & (F.col("_n").isNull() | (s >= F.col("_n"))))
    # A row_number filter lets Spark cut each partition to the best few before the shuffle.
    ranked = peaks.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("strength"), "t")))
    return spaced(ranked.filter(F.col("_k") <= most).select(*by, "t"), by, "t", 0.001, inclusive=False)
