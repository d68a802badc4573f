"""Work on frame tables: windows of selected frames, strengths, peaks, smoothing, coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.functions.numeric import positive_rise, ratio
from tactus.layout import RUN, as_list, exact_quantiles, framed, row_index, running, shift
from tactus.operators.thinning import spaced
from tactus.session import settled

KEY = "recording"


def with_bounds(frames: DataFrame, hop: float) -> DataFrame:
    """Explicit start and end where present, else half a hop around the centre, not before zero."""
    have = lambda c: F.col(c) if c in frames.columns else F.lit(None).cast("double")
    return frames.withColumns({
        "t_start": F.coalesce(have("t_start"), F.greatest(F.col("t") - hop / 2, F.lit(0.0))),
        "t_end": F.coalesce(have("t_end"), F.col("t") + hop / 2)})


def selection_windows(selected: DataFrame, hop: float) -> DataFrame:
    """Number the contiguous windows of selected frames.

    A frame opens a window when it follows neither by frame number nor in time (1.25 hops, at least 1 ms) on what
    came before. Adds window_index and the window's bounds.
    """
    gap = max(0.001, hop * 1.25)
    rows = running(selected, KEY, "frame", {"_reach": ("max", "t_end")})
    rows = shift(rows, KEY, "frame", {"_pf": ("frame", -1), "_pe": ("_reach", -1)})
    opens = F.col("_pf").isNull() | ((F.col("frame") > F.col("_pf") + 1) & (F.col("t_start") > F.col("_pe") + gap))
    rows = running(rows.withColumn("_open", opens.cast("long")), KEY, "frame", {"window_index": ("sum", "_open")})
    rows = rows.withColumn("window_index", F.col("window_index") - 1).drop("_reach", "_pf", "_pe", "_open")
    bounds = rows.groupBy(KEY, "window_index").agg(F.min("t_start").alias("w_start"), F.max("t_end").alias("w_end"),
                                                   F.count(F.lit(1)).alias("w_frames"))
    return rows.join(bounds, [KEY, "window_index"])


def with_strength(windowed: DataFrame, method: str) -> DataFrame:
    """Rise of volume, or mean positive rise over all bins but the first, against the previous frame of the window."""
    value = "volume" if method == "volume_delta" else "bins"
    rows = shift(windowed, KEY, "frame", {"_pv": (value, -1), "_pw": ("window_index", -1)})
    same = F.col("_pw") == F.col("window_index")
    if method == "volume_delta":
        rise = F.greatest(F.col("volume") - F.col("_pv"), F.lit(0.0))
    else:
        tail = lambda c: F.slice(c, 2, F.size(c))
        rise = positive_rise(tail(F.col("bins")), tail(F.col("_pv"))) / F.nullif(F.size("bins") - 1, F.lit(0))
    return rows.withColumns({"strength": F.when(same, rise).otherwise(F.lit(0.0)), "_inner": F.coalesce(same, F.lit(False))}
                            ).drop("_pv", "_pw")


def window_peaks(rows: DataFrame, *, sensitivity: float = 1.0, scale: float = 1.0) -> DataFrame:
    """Frames whose strength passes the window's threshold and is no lower than both neighbours.

    A window without such a frame gives its strongest frame (the first on a tie) if within 90 % of the threshold.
    """
    by = [KEY, "window_index"]
    positive = rows.filter(F.col("_inner") & (F.col("strength") > 0))
    stats = positive.groupBy(*by).agg(F.avg("strength").alias("_mean"), F.stddev_pop("strength").alias("_std"))
    mid = exact_quantiles(positive, by, "strength", [0.5], "_med", rule="upper")
    base = F.greatest(F.lit(1e-6), F.col("_med")[0] * 1.15, F.col("_mean") + F.col("_std") * 0.18)
    limit = F.greatest(F.lit(1e-6), base * max(0.1, scale) / max(0.2, sensitivity))
    limits = stats.join(mid, by).select(*by, limit.alias("threshold"))
    beside = shift(rows, KEY, "frame", {"_ps": ("strength", -1), "_ns": ("strength", 1), "_nw": ("window_index", 1)})
    beside = beside.join(limits, by)
    after = F.when(F.col("_nw") == F.col("window_index"), F.col("_ns")).otherwise(F.lit(0.0))
    s = F.col("strength")
    peak = F.col("_inner") & (s >= F.col("threshold")) & (s >= F.col("_ps")) & (s >= after)
    marked = beside.withColumn("_peak", peak)
    best = marked.filter("_inner").groupBy(*by).agg(
        F.max(F.col("_peak").cast("int")).alias("_any"), F.max_by("frame", F.struct("strength", -F.col("frame"))).alias("_best"),
        F.max("strength").alias("_top"))
    out = marked.join(best, by)
    fallback = (F.col("_any") == 0) & (F.col("frame") == F.col("_best")) & (F.col("_top") >= F.col("threshold") * 0.9)
    return out.filter(F.col("_peak") | fallback).drop("_ps", "_ns", "_nw", "_peak", "_any", "_best", "_top")


def selection_onsets(selected: DataFrame, hop: float, *, method: str = "spectral_flux", has_bins: bool = True,
                     sensitivity: float = 1.0, scale: float = 1.0) -> DataFrame:
    """Onset events of a frame selection: flux when bins exist, else volume; close events keep the strongest."""
    used = method if method == "volume_delta" or has_bins else "volume_delta"
    rows = with_strength(selection_windows(with_bounds(selected, hop), hop), used)
    # The peak rule reads these few columns several times; the bins stay behind.
    need = (KEY, "frame", "t", "strength", "window_index", "_inner", RUN)
    rows = settled(rows.select(*[c for c in need if c in rows.columns]))
    peaks = window_peaks(rows, sensitivity=sensitivity, scale=scale)
    keep = [c for c in (KEY, "frame", "t", "strength", "threshold", "window_index", RUN) if c in peaks.columns]
    events = spaced(peaks.select(*keep), KEY, "t", max(0.01, hop * 1.5), inclusive=False, strength="strength", ties=["frame"])
    return events.withColumn("method", F.lit(used))


def event_intervals(events: DataFrame) -> DataFrame:
    """Seconds since the previous event of the recording, never negative."""
    rows = shift(events, KEY, ["t", "frame"], {"_pt": ("t", -1)})
    gap = F.greatest(F.col("t") - F.col("_pt"), F.lit(0.0))
    return rows.withColumn("ioi_sec", F.when(F.col("_pt").isNotNull(), gap)).drop("_pt")


def spaced_maxima(curve: DataFrame, value: str, t: str, spacing_ms: float, hop: float) -> DataFrame:
    """Strict local maxima, at least the spacing apart; a higher one replaces a closer lower one."""
    frames = max(1, int(round(spacing_ms / 1000.0 / hop)))
    rows = shift(curve, KEY, "frame", {"_p": (value, -1), "_n": (value, 1)})
    peaks = rows.filter((F.col(value) > F.col("_p")) & (F.col(value) > F.col("_n"))).drop("_p", "_n")
    return spaced(peaks, KEY, "frame", float(frames), strength=value)


def gap_filled(intervals: DataFrame, *, tolerance: float = 0.001) -> DataFrame:
    """Insert an empty interval before each gap and one up to the end of the recording.

    Needs recording, seq, start, end, label, duration.
    """
    rows = shift(intervals, KEY, "seq", {"_pe": ("end", -1), "_ns": ("start", 1)})
    before = F.coalesce("_pe", F.lit(0.0))
    part = lambda s, e, l, k: F.struct(s.alias("start"), e.alias("end"), l.alias("label"), F.lit(k).alias("part"))
    blank = F.lit("")
    parts = F.array_compact(F.array(
        F.when(F.col("start") > before + tolerance, part(before, F.col("start"), blank, 0)),
        part(F.col("start"), F.col("end"), F.col("label"), 1),
        F.when(F.col("_ns").isNull() & (F.col("end") < F.col("duration")), part(F.col("end"), F.col("duration"), blank, 2))))
    return rows.select(KEY, "seq", F.explode(parts).alias("_x")).select(KEY, "seq", "_x.*")


# Arrays of bins

def resampled(bins: Column, n: int, target: int) -> Column:
    """Nearest source bin at evenly spaced positions; halves round to even."""
    if n == 0:
        return F.array_repeat(F.lit(0.0), target)
    if n == target:
        return bins
    at = [round(i * (n - 1) / (target - 1)) if target > 1 else 0 for i in range(target)]
    return F.transform(F.array(*[F.lit(i + 1) for i in at]), lambda i: F.element_at(bins, i))


def smoothed_envelope(frames: DataFrame, bins: int, *, target: int, smoothing: float, power: float,
                      padding_pct: float) -> DataFrame:
    """Exponentially smoothed bins in frame order with the peak and its bin (the highest on a tie).

    The recurrence is cut into blocks of frames: inside a block it is a running sum of scaled values, and only the
    block's last state passes on. A block is long enough for older states to vanish in double precision, and short
    enough for the scaling not to overflow, so long recordings split over tasks.
    """
    import math
    length = max(1, int(math.ceil(110 / -math.log10(smoothing)))) if 0 < smoothing < 1 else 1
    top = frames.groupBy(KEY).agg(F.max(F.array_max("bins")).alias("_top"))
    rows = frames.join(top, KEY)
    ceiling = F.when(F.col("_top") > 0, F.col("_top") * (1 + max(0.0, padding_pct) / 100)).otherwise(F.lit(1.0))
    rows = rows.withColumn("_c", ceiling).withColumn("_e", F.transform(
        resampled(F.col("bins"), bins, target),
        lambda v: F.pow(F.least(F.greatest(v, F.lit(0.0)), F.col("_c")) / F.col("_c"), F.lit(float(power)))))
    rows = rows.withColumns({"_block": F.floor(F.col("frame") / length), "_k": F.col("frame") % length})
    s = F.lit(float(smoothing))
    rows = rows.withColumn("_scaled", F.transform("_e", lambda v: v * F.pow(s, -F.col("_k"))))
    w = Window.partitionBy(KEY, "_block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    sums = F.array(*[F.sum(F.element_at("_scaled", i + 1)).over(w) for i in range(target)])
    rows = rows.withColumn("_sum", sums)
    rows = rows.withColumn("_local", F.transform("_sum", lambda v: v * (1 - s) * F.pow(s, F.col("_k"))))
    ends = rows.groupBy(KEY, "_block").agg(F.max_by("_local", "frame").alias("_end"), F.max("_k").alias("_last"))
    ends = ends.select(KEY, (F.col("_block") + 1).alias("_block"), F.col("_end").alias("_carry"))
    rows = rows.join(ends, [KEY, "_block"], "left")
    state = F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(
        F.zip_with("_local", "_carry", lambda a, b: a + b * F.pow(s, F.col("_k") + 1)))
    rows = rows.withColumn("smoothed", state).withColumn("peak", F.array_max("smoothed"))
    last = F.lit(target) - F.array_position(F.reverse("smoothed"), F.col("peak"))
    return rows.withColumn("peak_bin", last).drop("_top", "_c", "_e", "_block", "_k", "_scaled", "_sum", "_local", "_carry", "_end", "_last")


# Coordinates

def centred_cloud(frames: DataFrame, *, side: float = 100.0, key: str | Sequence[str] = KEY) -> DataFrame:
    """Points moved to the centre of their box and scaled so that the longest side has the given length."""
    keys = as_list(key)
    box = frames.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = frames.join(box, keys)
    longest = F.greatest(*[F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in "xyz"])
    rows = rows.withColumn("_s", F.lit(side) / F.nullif(longest, F.lit(0.0)))
    return rows.withColumns({f"n{c}": (F.col(c) - (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2) * F.col("_s") for c in "xyz"}).drop(
        "_s", *[f"_{n}_{c}" for c in "xyz" for n in ("lo", "hi")])


def unit_columns(frames: DataFrame, columns: Sequence[str], *, key: str | Sequence[str] = KEY) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    keys = as_list(key)
    box = frames.groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    rows = frames.join(box, keys)
    span = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).otherwise(F.lit(1.0))
    return rows.withColumns({f"n{c}": (F.col(c) - F.col(f"_lo_{c}")) / span(c) for c in columns}).drop(
        *[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def short_clip_coordinates(frames: DataFrame, first: str, second: str) -> DataFrame:
    """x runs from -1 to 1 over the frames; y and z are the two features scaled to [-0.5, 0.5]."""
    rows = row_index(frames, KEY, "frame", "_i")
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    rows = unit_columns(rows.join(counts, KEY), [first, second])
    x = F.when(F.col("_n") > 1, F.lit(-1.0) + 2.0 * (F.col("_i") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(F.lit(0.0))
    return rows.withColumns({"cx": x, "cy": F.col(f"n{first}") - 0.5, "cz": F.col(f"n{second}") - 0.5}).drop(
        "_i", "_n", f"n{first}", f"n{second}")


def trajectory_steps(frames: DataFrame) -> DataFrame:
    """Distances between successive points: median, mean, p95, p99 (element floor(p*n)), max and max over median."""
    rows = shift(frames, KEY, "frame", {f"_{c}": (c, -1) for c in "xyz"})
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in "yz"), F.pow(F.col("x") - F.col("_x"), 2)))
    rows = rows.withColumn("d", d).filter("d IS NOT NULL")
    stats = rows.groupBy(KEY).agg(F.avg("d").alias("mean"), F.max("d").alias("max"))
    q = exact_quantiles(rows, KEY, "d", [0.5, 0.95, 0.99], "_q", rule="upper")
    med = F.col("_q")[0]
    return stats.join(q, KEY).select(KEY, med.alias("median"), "mean", F.col("_q")[1].alias("p95"), F.col("_q")[2].alias("p99"),
                                     "max", F.when(med > 0, F.col("max") / F.nullif(med, F.lit(0.0))).otherwise(F.lit(0.0)).alias("max_over_median"))


def template_mask(frames: DataFrame, vector: str, templates: Sequence[Sequence[Sequence[float]]], percentile: float) -> DataFrame:
    """Distance of every frame to the nearest template (sliding Euclidean distance, scaled to [0, 1]) and a mask of
    the frames at or below the given percentile.

    Edges without a full window take the largest inner distance. For a template of odd length the last inner frame
    has no distance and counts as 0, as the published rule has it.
    """
    rows = row_index(frames, KEY, "frame", "_i").withColumn("_i", F.col("_i") - 1)
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, KEY)
    scaled = []
    for k, template in enumerate(templates):
        t, half = len(template), len(template) // 2
        literal = F.array(*[F.array(*[F.lit(float(v)) for v in vec]) for vec in template])
        square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
        # The window that starts `half` rows earlier is centred on this row.
        rows = framed(rows, KEY, "frame", {"_w": lambda w: F.collect_list(vector).over(w)}, half, t - 1 - half)
        dist = F.sqrt(F.aggregate(F.zip_with("_w", literal, square), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))))
        inner = (F.col("_i") >= half) & (F.col("_i") - half < F.col("_n") - t)
        interior = (F.col("_i") >= half) & (F.col("_i") < F.col("_n") - half)
        rows = rows.withColumn("_d", F.when(inner, dist).when(interior, F.lit(0.0))).drop("_w")
        edge = rows.groupBy(KEY).agg(F.max("_d").alias("_m"))
        rows = rows.join(edge, KEY).withColumn("_d", F.coalesce("_d", F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0)))).drop("_m")
        box = rows.groupBy(KEY).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
        rows = rows.join(box, KEY).withColumn(f"_s{k}", F.when(
            F.col("_hi") > F.col("_lo"), ratio(F.col("_d") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.5))).drop("_d", "_lo", "_hi")
        scaled.append(F.col(f"_s{k}"))
    rows = rows.withColumn("distance", F.least(*scaled) if len(scaled) > 1 else scaled[0])
    cut = exact_quantiles(rows, KEY, "distance", [percentile / 100.0], "_q")
    return rows.join(cut, KEY).withColumn("kept", F.col("distance") <= F.col("_q")[0]).drop(
        "_i", "_n", "_q", *[f"_s{k}" for k in range(len(templates))])
