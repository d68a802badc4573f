"""Profiles of recordings and regions from frame tables and spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.numeric import decibel, ratio
from tactus.layout import exact_quantiles, framed, running, shift, within_spans
from tactus.operators.thinning import spaced

KEY = "recording"
BIN_HZ = 100.0
# Edges in Hz of the four bands of the spectral profile and of the noise-floor bands.
PROFILE_BANDS = (0.0, 200.0, 2000.0, 8000.0)
FLOOR_BANDS = (0.0, 250.0, 1000.0, 4000.0)


def bin_means(frames: DataFrame, *, power: int = 1, key: Sequence[str] = (KEY,), extra: Sequence[Column] = ()) -> DataFrame:
    """Mean magnitude (or power) of every bin, long form; combined map-side to one row per key and bin."""
    value = F.pow(F.col("mag"), power) if power != 1 else F.col("mag")
    long = frames.select(*key, F.posexplode("bins").alias("bin", "mag"))
    return long.groupBy(*key, "bin").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *extra).withColumn(
        "freq_hz", F.col("bin") * F.lit(BIN_HZ))


def spectral_profile(frames: DataFrame, *, top_hz: float = BIN_HZ * 64) -> DataFrame:
    """Dominant frequency, centroid, bandwidth and band shares of the mean power spectrum."""
    rows = bin_means(frames, power=2)
    f, m = F.col("freq_hz"), F.col("mean")
    edges = [*PROFILE_BANDS, max(top_hz, PROFILE_BANDS[-1])]
    share = lambda lo, hi: F.sum(F.when((f >= lo) & (f < hi), m).otherwise(0.0))
    names = ["below_200", "to_2000", "to_8000", "above_8000"]
    agg = rows.groupBy(KEY).agg(
        F.sum(m).alias("_t"), F.sum(f * m).alias("_fm"), F.max_by(f, F.struct(m, -F.col("bin"))).alias("dominant_hz"),
        *[share(lo, hi).alias(f"_{n}") for n, lo, hi in zip(names, edges, edges[1:], strict=False)])
    agg = agg.withColumn("centroid_hz", ratio(F.col("_fm"), F.col("_t")))
    spread = rows.join(agg.select(KEY, "centroid_hz"), KEY).groupBy(KEY).agg(
        F.sum(m * F.pow(f - F.col("centroid_hz"), 2)).alias("_v"))
    out = agg.join(spread, KEY)
    live = F.col("_t") >= 1e-10
    put = lambda c, d: F.round(F.when(live, c).otherwise(F.lit(0.0)), d)
    return out.select(
        KEY, put(F.col("dominant_hz"), 1).alias("dominant_hz"), put(F.col("centroid_hz"), 1).alias("centroid_hz"),
        put(F.sqrt(ratio(F.col("_v"), F.col("_t"))), 1).alias("bandwidth_hz"),
        *[put(ratio(F.col(f"_{n}"), F.col("_t")), 4).alias(n) for n in names])


def level_profile(frames: DataFrame) -> DataFrame:
    """Noise floor, signal-to-noise ratio and dynamic range in dB from frame levels above zero."""
    live = frames.filter("rms > 0")
    q = exact_quantiles(live, KEY, "rms", [0.05, 0.10, 0.90], "_q")
    n = live.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.max("rms").alias("_max"))
    rows = frames.select(KEY).distinct().join(n.join(q, KEY), KEY, "left")
    p5, p10, p90 = (F.col("_q")[i] for i in range(3))
    n = F.coalesce("_n", F.lit(0))
    return rows.select(
        KEY, F.when(n > 0, decibel(p10)).otherwise(F.lit(-80.0)).alias("noise_floor_db"),
        F.when(n < 10, 20.0).when(p10 < 1e-10, 60.0).otherwise(20 * F.log10(ratio(p90, p10))).alias("snr_db"),
        F.when(n < 2, 0.0).otherwise(F.round(20 * F.log10("_max") - 20 * F.log10(p5), 1)).alias("dynamic_range_db"))


def noise_floor(frames: DataFrame, *, bins: int = 50) -> DataFrame:
    """Median of three floor estimates in dB: 10th percentile, quiet-frame band median, mode of the lower half."""
    rows = frames.withColumn("_db", decibel(F.col("rms")))
    q = exact_quantiles(rows, KEY, "_db", [0.10, 0.20, 0.50], "_q").select(
        KEY, F.col("_q")[0].alias("_p10"), F.col("_q")[1].alias("_p20"), F.col("_q")[2].alias("_p50"))
    peaks = rows.groupBy(KEY).agg(F.max("_db").alias("peak_db"), F.max(F.array_max("bins")).alias("_ref"))
    rows = rows.join(q, KEY).join(peaks, KEY)
    # Band levels relative to the loudest cell, not more than 80 dB below it.
    quiet = rows.filter(F.col("_db") <= F.col("_p20")).select(KEY, "_ref", F.posexplode("bins").alias("bin", "mag"))
    f = F.col("bin") * BIN_HZ
    band = sum((F.when(f >= e, 1).otherwise(0) for e in FLOOR_BANDS[1:]), F.lit(0))
    cell = F.greatest(decibel(F.col("mag"), 1e-5) - decibel(F.col("_ref"), 1e-5), F.lit(-80.0))
    bands = exact_quantiles(quiet.select(KEY, band.alias("band"), cell.alias("cell")), [KEY, "band"], "cell", [0.5], "_b")
    per_band = bands.groupBy(KEY).agg(*[F.max(F.when(F.col("band") == i, F.col("_b")[0])).alias(f"_b{i}") for i in range(4)])
    levels = F.array_sort(F.array(*[F.coalesce(f"_b{i}", F.lit(-80.0)) for i in range(4)]))
    per_band = per_band.select(KEY, ((levels[1] + levels[2]) / 2).alias("_spectral"))
    low = rows.filter(F.col("_db") <= F.col("_p50"))
    box = low.groupBy(KEY).agg(F.min("_db").alias("_lo"), F.max("_db").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = F.least(F.floor(F.coalesce((F.col("_db") - F.col("_lo")) / span, F.lit(0.5)) * bins), F.lit(bins - 1))
    hist = low.join(box, KEY).groupBy(KEY, at.alias("_i")).agg(F.count(F.lit(1)).alias("_c"))
    mode = hist.groupBy(KEY).agg(F.max_by("_i", F.struct("_c", -F.col("_i"))).alias("_i"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0)) / bins
    base = F.when(F.col("_hi") > F.col("_lo"), F.col("_lo")).otherwise(F.col("_lo") - 0.5)
    mode_db = base + (F.col("_i") + 0.5) * width
    out = q.join(peaks, KEY).join(per_band, KEY).join(box, KEY).join(mode, KEY)
    out = out.withColumn("_mode", F.when(F.col("_n") > 10, mode_db).otherwise(F.col("_p10")))
    three = F.array_sort(F.array("_p10", "_spectral", "_mode"))
    return out.select(KEY, three[1].alias("noise_floor_db"), "peak_db", F.col("_p10").alias("percentile_db"),
                      F.col("_spectral").alias("spectral_db"), F.col("_mode").alias("mode_db"))


def top_db(levels: DataFrame, *, margin: float = 6.0, low: float = 10.0, high: float = 60.0) -> DataFrame:
    """Distance from the peak to the floor plus margin, clipped."""
    return levels.withColumn("top_db", F.least(F.greatest(
        F.col("peak_db") - (F.col("noise_floor_db") + margin), F.lit(low)), F.lit(high)))


def edit_plan(frames: DataFrame, levels: DataFrame, *, threshold_db: float, ratio_: float) -> DataFrame:
    """Per frame: level, gain of upward compression and whether the frame stays after muting below peak - top_db."""
    rows = frames.withColumn("rms_db", decibel(F.col("rms"))).join(levels.select(KEY, "peak_db", "top_db"), KEY)
    gain = F.when(F.col("rms_db") < threshold_db, (F.lit(threshold_db) - F.col("rms_db")) * (1 - 1 / ratio_)).otherwise(F.lit(0.0))
    return rows.withColumns({"gain_db": gain, "audible": F.col("rms_db") > F.col("peak_db") - F.col("top_db")}).drop("peak_db", "top_db")


def audible_spans(plan: DataFrame) -> DataFrame:
    """Stretches of consecutive audible frames."""

    rows = shift(plan.filter("audible"), KEY, "frame", {"_pf": ("frame", -1)})
    opens = F.coalesce(F.col("frame") > F.col("_pf") + 1, F.lit(True)).cast("long")
    rows = running(rows.withColumn("_o", opens), KEY, "frame", {"span": ("sum", "_o")})
    return rows.groupBy(KEY, "span").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def tonal_noise(frames: DataFrame, *, low_hz: float = 30.0, high_hz: float, prominence: float = 5.0, level: float = 3.0,
                local: float = 1.5, merge_hz: float = 10.0, most: int = 5) -> DataFrame:
    """Steady, prominent bins: mean over deviation and mean power well above their medians and above the neighbours.

    Works on one row per bin; at most `most` frequencies per recording are reported, lowest first, `merge_hz` apart.
    """
    rows = bin_means(frames, power=2).withColumn("_p", F.col("mean") / (F.col("std") + 1e-10))
    medians = exact_quantiles(rows, KEY, "_p", [0.5], "_mp").join(exact_quantiles(rows, KEY, "mean", [0.5], "_mm"), KEY)
    rows = framed(rows, KEY, "bin", {"_near": lambda w: F.avg("mean").over(w)}, 3, 3).join(medians, KEY)
    loud = rows.groupBy(KEY).agg(F.max("mean").alias("_top")).filter("_top >= 1e-10").select(KEY)
    hits = rows.join(loud, KEY).filter(
        F.col("freq_hz").between(low_hz, high_hz) & (F.col("_p") > F.col("_mp")[0] * prominence)
        & (F.col("mean") > F.col("_mm")[0] * level) & (F.col("mean") > F.col("_near") * local))
    kept = spaced(hits.select(KEY, F.round("freq_hz", 1).alias("freq_hz")), KEY, "freq_hz", merge_hz, inclusive=False)
    return kept.groupBy(KEY).agg(F.slice(F.array_sort(F.collect_list("freq_hz")), 1, most).alias("tones"))


def noise_stationarity(frames: DataFrame) -> DataFrame:
    """1 - mean absolute deviation of the quietest quarter's spectra from their mean, over that mean; in [0, 1]."""
    energy = F.aggregate("bins", F.lit(0.0), lambda s, v: s + v * v)
    rows = frames.select(KEY, "frame", "bins", energy.alias("_e"))
    q = exact_quantiles(rows, KEY, "_e", [0.25], "_q")
    quiet = rows.join(q, KEY).filter(F.col("_e") <= F.col("_q")[0])
    means = bin_means(quiet).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("bin", "mean"))).alias("_m"))
    means = means.select(KEY, F.col("_m.mean").alias("_m"))
    gap = F.aggregate(F.zip_with("bins", "_m", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("bins")
    out = quiet.join(means, KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.avg(gap).alias("_d"), F.first("_m").alias("_m"))
    level = F.aggregate("_m", F.lit(0.0), lambda s, v: s + v) / F.size("_m")
    score = F.round(F.greatest(F.least(1 - ratio(F.col("_d"), level), F.lit(1.0)), F.lit(0.0)), 3)
    return out.select(KEY, F.when((F.col("_n") < 5) | (level < 1e-10), F.lit(0.5)).otherwise(score).alias("stationarity"))


def region_features(regions: DataFrame, frames: DataFrame, *, width: float = 1.0, digits: bool = True) -> DataFrame:
    """Peak frequency, centroid, bandwidth, energy share and attack of each region (recording, region_id, t_start,
    t_end, f_low, f_high); regions without frames are left out."""
    by = [KEY, "region_id"]
    pairs = within_spans(regions.select(*by, "t_start", "t_end", "f_low", "f_high"), frames.select(KEY, "frame", "t", "bins"),
                         KEY, "t_start", "t_end", "t", width)
    inside = lambda i: (i * BIN_HZ >= F.col("f_low")) & (i * BIN_HZ <= F.col("f_high"))
    band = F.transform("bins", lambda v, i: F.when(inside(i), v))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + F.coalesce(v * v, F.lit(0.0)))
    pairs = pairs.select(*by, "frame", band.alias("_band"), square(F.col("bins")).alias("_all"), square(band).alias("_env"))
    steps = shift(pairs.drop("_band"), by, "frame", {"_pe": ("_env", -1)})
    energy = steps.groupBy(*by).agg(F.sum("_all").alias("_all"), F.sum("_env").alias("_reg"), F.max("_env").alias("_peak"),
                                    F.max(F.col("_env") - F.col("_pe")).alias("_rise"))
    long = pairs.select(*by, F.posexplode("_band").alias("bin", "mag")).filter("mag IS NOT NULL")
    means = long.groupBy(*by, "bin").agg(F.avg("mag").alias("m")).withColumn("f", F.col("bin") * F.lit(BIN_HZ))
    m, f = F.col("m"), F.col("f")
    # Second moment around the overall mean frequency avoids a second pass over the bins.
    shape = means.groupBy(*by).agg(
        F.max_by("f", F.struct("m", -F.col("bin"))).alias("peak_frequency_hz"), F.sum(m).alias("_s"), F.sum(m * f).alias("_s1"),
        F.sum(m * f * f).alias("_s2"))
    total = F.greatest(F.col("_s"), F.lit(1e-10))
    centroid = F.col("_s1") / total
    variance = (F.col("_s2") - 2 * centroid * F.col("_s1") + centroid * centroid * F.col("_s")) / total
    out = energy.join(shape, by)
    r = (lambda c, d: F.round(c, d)) if digits else (lambda c, d: c)
    return out.select(
        *by, r(F.col("peak_frequency_hz"), 1).alias("peak_frequency_hz"), r(centroid, 1).alias("spectral_centroid_hz"),
        r(F.sqrt(F.greatest(variance, F.lit(0.0))), 1).alias("spectral_bandwidth_hz"),
        r(F.col("_reg") / F.greatest("_all", F.lit(1e-10)), 4).alias("energy_ratio"),
        r(F.coalesce(F.col("_rise") / (F.col("_peak") + 1e-10), F.lit(0.0)), 4).alias("attack_sharpness"))


def spectral_template(regions: DataFrame, frames: DataFrame, *, width: float = 1.0) -> DataFrame:
    """Unit-length mean spectrum over the frames of positive regions, bins outside a region's band counted as zero.

    Long form: recording, bin, ref.
    """
    pairs = within_spans(regions.filter("polarity = 'positive'").select(KEY, "region_id", "t_start", "t_end", "f_low", "f_high"),
                         frames.select(KEY, "frame", "t", "bins"), KEY, "t_start", "t_end", "t", width)
    n = pairs.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    long = pairs.select(KEY, "f_low", "f_high", F.posexplode("bins").alias("bin", "mag"))
    f = F.col("bin") * BIN_HZ
    sums = long.groupBy(KEY, "bin").agg(F.sum(F.when(f.between(F.col("f_low"), F.col("f_high")), F.col("mag")).otherwise(0.0)).alias("_s"))
    means = sums.join(n, KEY).withColumn("_m", F.col("_s") / F.col("_n"))
    norms = means.groupBy(KEY).agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_l"))
    return means.join(norms, KEY).select(KEY, "bin", F.when(F.col("_l") > 0, F.col("_m") / F.nullif(F.col("_l"), F.lit(0.0)))
                                         .otherwise(F.col("_m")).alias("ref"))


def character(harmonicity: Column) -> Column:
    return F.when(harmonicity > 0.65, "harmonic").when(harmonicity < 0.35, "percussive").otherwise("mixed")


def signal_summary(analyses: DataFrame) -> DataFrame:
    """Frequency range, mean features and character over analysed regions of a recording."""
    avg = lambda c, d: F.round(F.avg(c), d)
    return analyses.groupBy(KEY).agg(
        F.round(F.min("f_low"), 1).alias("f_low"), F.round(F.max("f_high"), 1).alias("f_high"),
        avg("spectral_centroid_hz", 1).alias("spectral_centroid_hz"), avg("spectral_bandwidth_hz", 1).alias("spectral_bandwidth_hz"),
        avg("harmonicity", 4).alias("harmonicity"), avg("attack_sharpness", 4).alias("attack_sharpness"),
        avg("energy_ratio", 4).alias("energy_ratio"), avg(F.col("t_end") - F.col("t_start"), 4).alias("avg_duration_s"),
        character(F.avg("harmonicity")).alias("signal_character"), F.count(F.lit(1)).alias("n_regions"))


def marked_profile(marks: DataFrame) -> DataFrame:
    """Per recording and polarity: feature means, frequency range and character; for positives also interval figures.

    Needs recording, polarity, t, event_id and the feature columns of an analysed onset.
    """
    by = [KEY, "polarity"]
    avg = lambda c, d: F.round(F.avg(c), d)
    rows = shift(marks, by, ["t", "event_id"], {"_pt": ("t", -1)}).withColumn("_i", (F.col("t") - F.col("_pt")) * 1000)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_onsets"), F.round(F.min("peak_frequency_hz"), 1).alias("f_low"),
        F.round(F.max("peak_frequency_hz"), 1).alias("f_high"), avg("spectral_centroid_hz", 1).alias("mean_centroid_hz"),
        avg("spectral_bandwidth_hz", 1).alias("mean_bandwidth_hz"), avg("attack_sharpness", 4).alias("mean_sharpness"),
        avg("harmonicity", 4).alias("mean_harmonicity"), character(F.avg("harmonicity")).alias("signal_character"),
        F.round(F.min("_i"), 2).alias("_min"), F.round(F.max("_i"), 2).alias("_max"), F.round(F.avg("_i"), 2).alias("_mean"),
        F.round(F.stddev_pop("_i"), 2).alias("_std"))
    med = exact_quantiles(rows.filter("_i IS NOT NULL"), by, "_i", [0.5], "_q")
    out = out.join(med, by, "left").withColumn("_median", F.round(F.col("_q")[0], 2))
    positive = F.col("polarity") == "positive"
    return out.withColumns({f"{n}_ioi_ms": F.when(positive, F.col(f"_{n}")) for n in ("min", "max", "mean", "std", "median")}).drop(
        "_min", "_max", "_mean", "_std", "_median", "_q")


def transient_profile(onsets: DataFrame) -> DataFrame:
    """Attack slope and local energy over the onsets of a recording (columns slope and energy)."""
    med = exact_quantiles(onsets.withColumn("slope", F.greatest("slope", F.lit(0.0))), KEY, "slope", [0.5], "_q")
    s, e = F.greatest(F.col("slope"), F.lit(0.0)), F.col("energy")
    out = onsets.groupBy(KEY).agg(
        F.round(F.avg(s), 6).alias("mean_attack_slope"), F.round(F.avg(e), 6).alias("mean_local_energy"),
        F.round(F.stddev_pop(s) / F.greatest(F.avg(s), F.lit(1e-10)), 3).alias("attack_slope_cv"),
        F.round(F.stddev_pop(e) / F.greatest(F.avg(e), F.lit(1e-10)), 3).alias("energy_cv"))
    return out.join(med, KEY).withColumn("median_attack_slope", F.round(F.col("_q")[0], 6)).drop("_q")


def pitch_summary(track: DataFrame, *, order: str = "frame") -> DataFrame:
    """Mean, deviation, range and jitter of voiced fundamental frequency; null below two voiced frames."""
    voiced = track.filter("f0 > 0").withColumn("_p", 1 / F.col("f0"))
    voiced = shift(voiced, KEY, order, {"_pp": ("_p", -1)})
    agg = voiced.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("f0").alias("f0_mean"), F.stddev_pop("f0").alias("f0_std"), F.min("f0").alias("f0_min"),
        F.max("f0").alias("f0_max"), (F.avg(F.abs(F.col("_p") - F.col("_pp"))) / F.avg("_p")).alias("jitter"))
    agg = agg.filter("_n >= 2").withColumn("f0_range", F.col("f0_max") - F.col("f0_min"))
    return agg.select(KEY, *[F.round(c, 2).alias(c) for c in ("f0_mean", "f0_std", "f0_min", "f0_max", "f0_range")],
                      F.round("jitter", 6).alias("jitter"))


def selection_summary(frames: DataFrame, features: Sequence[str], start_bin: int, end_bin: int) -> DataFrame:
    """Mean, min, max, deviation of the features, and energy share, mean and peak of the selected bins."""
    band = F.slice("bins", start_bin + 1, end_bin - start_bin + 1)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    stats = [fn(c).alias(f"{c}_{n}") for c in features
             for n, fn in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))]
    out = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("frame_count"), *stats, F.sum(total("bins")).alias("_all"),
                                  F.sum(total(band)).alias("_sel"), F.sum(F.size(band)).alias("_cells"), F.max(F.array_max(band)).alias("band_peak"))
    return out.withColumns({"energy_ratio": F.when(F.col("_all") > 0, ratio(F.col("_sel"), F.col("_all"))).otherwise(F.lit(0.0)),
                            "band_mean": ratio(F.col("_sel"), F.col("_cells"))}).drop("_all", "_sel", "_cells")


def coefficient_profile(frames: DataFrame, vector: str = "bins", count: int = 13) -> DataFrame:
    """Mean and deviation of each of the first coefficients."""
    long = frames.select(KEY, F.posexplode(F.slice(vector, 1, count)).alias("coefficient", "v"))
    return long.groupBy(KEY, "coefficient").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def mask_statistics(frames: DataFrame, start_bin: int, end_bin: int, low_pct: float, high_pct: float) -> DataFrame:
    """Cells of the selected bins whose magnitude is between two percentages of the band's peak, and their energy share."""
    band = F.slice("bins", start_bin + 1, end_bin - start_bin + 1)
    peaks = frames.groupBy(KEY).agg(F.max(F.array_max(band)).alias("band_peak"))
    rows = frames.join(peaks, KEY)
    lo, hi = F.col("band_peak") * (low_pct / 100), F.col("band_peak") * (high_pct / 100)
    kept = F.filter(band, lambda v: (v >= lo) & (v <= hi))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    out = rows.groupBy(KEY).agg(F.sum(F.size(kept)).alias("kept_cells"), F.sum(F.size("bins")).alias("total_cells"),
                                F.sum(total(kept)).alias("_k"), F.sum(total("bins")).alias("_t"), F.max("band_peak").alias("band_peak"))
    return out.withColumn("kept_energy_ratio", F.when(F.col("_t") > 0, ratio(F.col("_k"), F.col("_t"))).otherwise(F.lit(0.0))).drop("_k", "_t")


def selection_bounds(frames: DataFrame, key: Sequence[str] = (KEY,)) -> DataFrame:
    """Frame, time and coordinate bounds and the duration of selected frames."""
    out = frames.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("frame_min"), F.max("frame").alias("frame_max"),
        F.min("t_start").alias("time_min"), F.max("t_end").alias("time_max"),
        *[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return out.withColumn("duration", F.greatest(F.col("time_max") - F.col("time_min"), F.lit(0.0)))


def bin_table_statistics(frames: DataFrame) -> DataFrame:
    """Rows, bins, min, max, 95 % value (element floor(0.95 n)) and highest non-zero bin of a bin table."""
    long = frames.select(KEY, F.posexplode("bins").alias("bin", "mag"))
    out = long.groupBy(KEY).agg(F.min("mag").alias("low"), F.max("mag").alias("high"),
                                F.coalesce(F.max(F.when(F.col("mag") != 0, F.col("bin"))), F.lit(-1)).alias("top_bin"))
    size = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("bins")).alias("n_bins"))
    q = exact_quantiles(long, KEY, "mag", [0.95], "_q", rule="upper")
    return out.join(size, KEY).join(q, KEY).select(KEY, "n_rows", "n_bins", "low", "high", F.col("_q")[0].alias("p95"), "top_bin")


# Rule tables

def filter_settings(profile: DataFrame, *, top_hz: float) -> DataFrame:
    """Suggested high-pass and low-pass from the signal's band, where known, else from band energy shares.

    Optional columns: sig_low, sig_high (wanted band), neg_low, neg_high (unwanted band).
    """
    c = F.col
    has, has_neg = c("sig_low").isNotNull(), c("neg_high").isNotNull()
    base = F.floor(F.greatest(F.lit(20.0), c("sig_low") - F.greatest(F.lit(50.0), c("sig_low") * 0.3)))
    raised = F.least(F.greatest(base, F.bround(c("neg_high") / 10) * 10), F.greatest(F.lit(20.0), F.floor(c("sig_low") - 30)))
    high = F.when(has & has_neg & (c("neg_high") < c("sig_low")), raised).when(has, F.bround(base / 10) * 10).when(
        c("below_200") < 0.05, 200.0).when(c("below_200") < 0.15, 100.0).otherwise(60.0)
    base_low = F.least(F.lit(float(int(top_hz - 100))), F.floor(c("sig_high") + F.greatest(F.lit(500.0), c("sig_high") * 0.3)))
    lowered = F.greatest(F.least(base_low, F.bround(c("neg_low") / 100) * 100), F.floor(c("sig_high") + 100))
    low = F.when(has & (c("sig_high") < top_hz - 500), F.when(has_neg & (c("neg_low") > c("sig_high")), lowered).otherwise(
        F.bround(base_low / 100) * 100)).when(c("above_8000") > 0.15, 0.0).when(c("above_8000") < 0.02, 8000.0).otherwise(0.0)
    return profile.withColumns({"highpass_hz": high.cast("double"), "lowpass_hz": low.cast("double")})


def method_choice(marked: DataFrame) -> DataFrame:
    """Suggested detector, by its registered name, from the characters of wanted and unwanted onsets (columns pos_* and neg_*)."""
    c = F.col
    harmonic = F.coalesce(c("pos_harmonicity"), F.lit(0.5)) > 0.7
    sharp = F.coalesce(c("pos_sharpness"), F.lit(0.3)) > 0.5
    tonal = (c("pos_character") == "harmonic") & F.coalesce(c("neg_character") == "percussive", F.lit(False))
    clash = (c("pos_character") == "percussive") & F.coalesce(c("neg_character") == "harmonic", F.lit(False))
    method = F.when(harmonic, "spectral_flux").when(sharp | clash, "baseline_crossing").when(tonal, "spectral_flux").otherwise("baseline_crossing")
    return marked.withColumn("method", method)
