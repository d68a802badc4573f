"""Selections: windows in time, frequency and amplitude, plane boxes, polygons, and sets of frame ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.layout import as_list

KEY = "recording"
PLANES = {"xz": ("x", "z"), "yz": ("y", "z"), "xy": ("x", "y")}


def time_window(start: float | None, end: float | None, duration: float) -> tuple[float, float]:
    """Clamp a requested window to the clip; an empty one is an error."""
    clamp = (lambda v: min(max(v, 0.0), duration)) if duration > 0 else (lambda v: max(0.0, v))
    lo, hi = clamp(0.0 if start is None else start), clamp(duration if end is None else end)
    if hi <= lo:
        raise ValueError("the selection's time window is empty")
    return lo, hi


def frequency_window(start: int | None, end: int | None, total: int, available: int) -> tuple[int, int]:
    """Clamp a requested bin range to the bins there are."""
    n = max(1, min(total, available))
    lo = min(max(start or 0, 0), n - 1)
    return lo, min(max(n - 1 if end is None else end, lo), n - 1)


def amplitude_window(low: float | None, high: float | None) -> tuple[float, float]:
    lo = min(max(0.0 if low is None else low, 0.0), 100.0)
    return lo, min(max(100.0 if high is None else high, lo), 100.0)


def in_time(frames: DataFrame, start: float, end: float) -> DataFrame:
    return frames.filter(F.col("t").between(start, end))


def in_band(bins: Column, start: int, end: int) -> Column:
    return F.slice(bins, start + 1, end - start + 1)


def in_amplitude(spectrum: DataFrame, start_bin: int, end_bin: int, low_pct: float, high_pct: float) -> DataFrame:
    """Cells of the bin range between two percentages of the recording's peak within that range."""
    band = spectrum.filter(F.col("bin").between(start_bin, end_bin))
    peaks = band.groupBy(KEY).agg(F.max("mag").alias("_peak"))
    rows = band.join(peaks, KEY)
    return rows.filter(F.col("mag").between(F.col("_peak") * (low_pct / 100), F.col("_peak") * (high_pct / 100))).drop("_peak")


def percent_frames(low_pct: Column, high_pct: Column, n: Column) -> tuple[Column, Column]:
    """Frame range of a percentage range: the nearest frames, halves up, inside the clip."""
    last = F.greatest(n - 1, F.lit(0))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    near = lambda c: F.floor(clamp(c) / 100 * last + 0.5)
    a, b = near(F.least(low_pct, high_pct)), near(F.greatest(low_pct, high_pct))
    return F.greatest(a, F.lit(0)), F.least(b, last)


def box_volume(planes: Mapping[str, Sequence[float]]) -> dict[str, tuple[float, float]] | None:
    """Intersect the axis ranges of the enabled planes; None unless all three axes are covered and non-empty.

    `planes` maps xz, yz or xy to (axis1 min, axis1 max, axis2 min, axis2 max) in percent.
    """
    ranges: dict[str, list[tuple[float, float]]] = {"x": [], "y": [], "z": []}
    clamp = lambda v: min(max(v, 0.0), 100.0)
    for name, (a0, a1, b0, b1) in planes.items():
        for axis, lo, hi in zip(PLANES[name], (a0, b0), (a1, b1), strict=True):
            ranges[axis].append((clamp(min(lo, hi)), clamp(max(lo, hi))))
    if not all(ranges.values()):
        return None
    box = {axis: (max(r[0] for r in rs), min(r[1] for r in rs)) for axis, rs in ranges.items()}
    return None if any(hi <= lo for lo, hi in box.values()) else box


def with_percents(frames: DataFrame, key: str | Sequence[str] = KEY) -> DataFrame:
    """Coordinates in percent of the recording's bounding box."""
    keys = as_list(key)
    box = frames.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = frames.join(box, keys)
    pct = lambda c: (F.col(c) - F.col(f"_lo_{c}")) / F.nullif(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(0.0)) * 100
    return rows.withColumns({f"{c}_pct": F.coalesce(pct(c), F.lit(0.0)) for c in "xyz"}).drop(
        *[f"_{n}_{c}" for c in "xyz" for n in ("lo", "hi")])


def in_box(frames: DataFrame, box: Mapping[str, tuple[float, float]] | None) -> DataFrame:
    """Frames inside the box (columns x_pct, y_pct, z_pct); none for a disabled box."""
    if box is None:
        return frames.filter(F.lit(False))
    for axis, (lo, hi) in box.items():
        frames = frames.filter(F.col(f"{axis}_pct").between(lo, hi))
    return frames


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule; fewer than three corners contain nothing."""
    if len(corners) < 3:
        return F.lit(False)
    crossings = []
    for (x0, y0), (x1, y1) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        if y0 == y1:
            continue
        spans = (F.lit(y0) > y) != (F.lit(y1) > y)
        crossings.append((spans & (x < (F.lit(x1 - x0) * (y - y0) / (y1 - y0) + x0))).cast("int"))
    return sum(crossings[1:], crossings[0]) % 2 == 1 if crossings else F.lit(False)


def by_planes(frames: DataFrame, planes: Mapping[str, Sequence]) -> DataFrame:
    """Frames inside every active plane, each a box (four percentages) or a polygon (corner pairs).

    The active planes must cover all three axes, else nothing is selected.
    """
    if len({axis for name in planes for axis in PLANES[name]}) < 3:
        return frames.filter(F.lit(False))
    for name, shape in planes.items():
        a, b = (F.col(f"{axis}_pct") for axis in PLANES[name])
        if shape and isinstance(shape[0], tuple | list):
            frames = frames.filter(in_polygon(a, b, shape))
        else:
            frames = frames.filter(a.between(shape[0], shape[1]) & b.between(shape[2], shape[3]))
    return frames


# Sets of frame ids

def normal_ids(ids: Column, limit: Column | None = None) -> Column:
    """Finite, rounded, distinct, non-negative (and below the limit), ascending."""
    whole = F.transform(F.filter(ids.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))),
                        lambda v: F.floor(v + 0.5).cast("long"))
    ok = (lambda v: (v >= 0) & (v < limit)) if limit is not None else (lambda v: v >= 0)
    return F.array_sort(F.array_distinct(F.filter(whole, ok)))


def merged(group: Column, chosen: Column) -> Column:
    return normal_ids(F.array_union(group, chosen))


def without(group: Column, chosen: Column) -> Column:
    """Difference; a removal that would empty the group changes nothing."""
    rest = F.array_except(group, chosen)
    return F.when(F.size(rest) == 0, group).otherwise(F.array_sort(rest))


def split(group: Column, chosen: Column) -> tuple[Column, Column]:
    """The chosen part and the rest; both null when either would be empty."""
    part, rest = F.array_intersect(group, chosen), F.array_except(group, chosen)
    ok = (F.size(part) > 0) & (F.size(rest) > 0)
    return F.when(ok, F.array_sort(part)), F.when(ok, F.array_sort(rest))


def effective(manual: DataFrame, box: DataFrame) -> DataFrame:
    """Union of two selections of (recording, frame)."""
    return manual.select(KEY, "frame").unionByName(box.select(KEY, "frame")).distinct()


def inverted(frames: DataFrame, selected: DataFrame) -> DataFrame:
    """All frames of the asset that are not selected."""
    return frames.join(selected.select(KEY, "frame"), [KEY, "frame"], "left_anti")


def union_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """Exact distinct union of onset layers."""
    out = layers[0].select(KEY, "t")
    for layer in layers[1:]:
        out = out.unionByName(layer.select(KEY, "t"))
    return out.distinct()


def copy_regions(regions: DataFrame, chosen: Column, layer: str, *, move: bool = False) -> DataFrame:
    """Copies of the chosen regions under another layer; with `move` the originals go."""
    copies = regions.filter(chosen).withColumn("layer", F.lit(layer))
    rest = regions.filter(~F.coalesce(chosen, F.lit(False))) if move else regions
    return rest.unionByName(copies)
