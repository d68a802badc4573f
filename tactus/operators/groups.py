"""Summaries and densities per group of recordings.

Groups are few and large, so every figure is built from partial aggregates or from value-ordered runs; nothing
collects a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.functions.numeric import unit_bin
from tactus.layout import exact_quantiles, framed, lay_out, plan_layout, row_index
from tactus.operators.intervals import isochronous
from tactus.operators.metrics import BINS, entropy

SQRT_2PI = 2.5066282746310002


def ratio_summary(ratios: DataFrame, groups: DataFrame, *, low: float = 0.45, high: float = 0.55) -> DataFrame:
    """Count, mean, median, sample deviation and isochronous share of r_k per group; listed groups without rows stay."""
    r = F.col("r_k")
    stats = ratios.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(r).alias("mean_r"), F.stddev_samp(r).alias("std_r"),
        F.avg(isochronous(r, low, high).cast("double")).alias("prop_iso"))
    medians = exact_quantiles(ratios, "grp", "r_k", [0.5], "_q")
    rows = groups.select("grp").distinct().join(stats, "grp", "left").join(medians, "grp", "left")
    return rows.select("grp", F.coalesce("n_events", F.lit(0)).alias("n_events"), "mean_r", F.col("_q")[0].alias("median_r"),
                       "std_r", "prop_iso")


def ratio_histogram(ratios: DataFrame, *, bins: int = 30, density: bool = False) -> DataFrame:
    """Histogram of r_k on [0, 1] per recording, per group and for everything, from one rollup."""
    rows = ratios.withColumn("bin", unit_bin(F.col("r_k"), bins))
    fine = rows.groupBy("grp", "recording", "bin").agg(F.count(F.lit(1)).alias("n"))
    levels = fine.withColumn("_level", F.explode(F.array(
        F.struct(F.lit("recording").alias("level"), F.col("grp").alias("g"), F.col("recording").alias("r")),
        F.struct(F.lit("group").alias("level"), F.col("grp").alias("g"), F.lit(None).cast("string").alias("r")),
        F.struct(F.lit("corpus").alias("level"), F.lit(None).cast("string").alias("g"), F.lit(None).cast("string").alias("r")))))
    out = levels.groupBy(F.col("_level.level").alias("level"), F.col("_level.g").alias("grp"),
                         F.col("_level.r").alias("recording"), "bin").agg(F.sum("n").alias("n"))
    if not density:
        return out
    totals = out.groupBy("level", "grp", "recording").agg(F.sum("n").alias("_t"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("level", "grp", "recording")]
    return out.alias("a").join(totals.alias("b"), same[0] & same[1] & same[2]).select(
        "a.*", (F.col("n") * F.lit(float(bins)) / F.col("_t")).alias("density"))


def isochrony_by_recording(ratios: DataFrame, *, low: float = 0.45, high: float = 0.55, min_events: int = 5) -> DataFrame:
    """Isochronous share per recording with enough events."""
    return ratios.groupBy("grp", "recording").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(isochronous(F.col("r_k"), low, high).cast("double")).alias("prop_iso")
    ).filter(F.col("n_events") >= min_events)


def isochrony_by_group(per_recording: DataFrame, *, low: float = 0.45, high: float = 0.55) -> DataFrame:
    return per_recording.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("prop_iso").alias("mean_prop"), F.stddev_samp("prop_iso").alias("sd_prop"),
        F.lit(high - low).alias("chance"))


def _cell(x: Column, low: float, high: float, bins: int) -> Column:
    """Histogram cell, the last one closed; null outside the range."""
    cell = F.least(F.floor((x - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return F.when((x >= low) & (x <= high), cell)


def tempo_ratio_density(pairs: DataFrame, x: str, *, x_range: tuple[float, float], bins: int = 40, min_events: int = 10,
                        normalise: str = "none") -> DataFrame:
    """Tempo by ratio histogram, pooled (null group) and per group with enough events.

    `per_group` scales each panel to sum 1, `joint` divides by the largest cell of all panels, `none` keeps counts.
    """
    cells = pairs.withColumns({"x_bin": _cell(F.col(x), *x_range, bins), "y_bin": _cell(F.col("r_k"), 0.0, 1.0, bins)})
    fine = cells.groupBy("grp", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    enough = fine.groupBy("grp").agg(F.sum("n").alias("_t")).filter(F.col("_t") >= min_events).select("grp")
    inside = fine.filter("x_bin IS NOT NULL AND y_bin IS NOT NULL")
    pooled = inside.groupBy("x_bin", "y_bin").agg(F.sum("n").alias("n")).withColumn("grp", F.lit(None).cast("string"))
    out = inside.join(enough, "grp", "left_semi").unionByName(pooled)
    if normalise == "per_group":
        # At most bins*bins cells per panel.
        totals = out.groupBy("grp").agg(F.sum("n").alias("_t"))
        return out.alias("a").join(totals.alias("b"), F.col("a.grp").eqNullSafe(F.col("b.grp"))).select(
            "a.grp", "x_bin", "y_bin", (F.col("n") / F.col("_t")).alias("z"))
    if normalise == "joint":
        top = out.agg(F.max("n").alias("m")).first()["m"] or 1
        return out.select("grp", "x_bin", "y_bin", (F.col("n") / F.lit(float(top))).alias("z"))
    return out.select("grp", "x_bin", "y_bin", F.col("n").cast("double").alias("z"))


def metric_distribution(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count, mean and five-number summary per group and metric; missing values are skipped."""
    long = rows.unpivot(["grp"], list(metrics), "metric", "value").filter("value IS NOT NULL")
    stats = long.groupBy("grp", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    five = exact_quantiles(long, ["grp", "metric"], "value", [0.0, 0.25, 0.5, 0.75, 1.0], "q")
    names = ["low", "q1", "median", "q3", "high"]
    return stats.join(five, ["grp", "metric"]).select(
        "grp", "metric", "n", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def unit_values(rows: DataFrame, metrics: Sequence[str], *, unit: str = "unit", by: str = "mean") -> DataFrame:
    """Mean or median of each metric per unit, skipping missing values."""
    rows = rows.filter(F.col(unit).isNotNull())
    if by == "mean":
        return rows.groupBy(unit).agg(*[F.avg(m).alias(m) for m in metrics])
    out = rows.select(unit).distinct()
    for m in metrics:
        out = out.join(exact_quantiles(rows, unit, m, [0.5], "_q").select(unit, F.col("_q")[0].alias(m)), unit, "left")
    return out


def numeric_complete(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Cast features to numbers, failing ones to null, and drop rows that miss any."""
    cast = rows.withColumns({f: F.col(f).try_cast("double") for f in features})
    return cast.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in features}).dropna(subset=list(features))


def drop_sparse_classes(rows: DataFrame, column: str, min_rows: int = 3) -> DataFrame:
    dense = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(column)
    return rows.join(dense, column, "left_semi")


def varying(rows: DataFrame, features: Sequence[str], least: float = 1e-12) -> list[str]:
    """Features whose population deviation exceeds the limit."""
    row = rows.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] > least]


def standardised(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is left as it is. The constants are two numbers per column."""
    row = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return rows.withColumns({f: (F.col(f) - F.lit(row[f"m_{f}"])) / F.lit(row[f"s_{f}"])
                             for f in features if row[f"s_{f}"]})


def dispersion_boundary(pairs: DataFrame, *, window: int = 50, threshold: float = 0.12, method: str = "std",
                        key: str = "grp", order: Sequence[str] = ("cycle_ms", "recording", "event_id")) -> DataFrame:
    """Cycle length at the centre of the first window, in cycle order, whose ratio dispersion exceeds the threshold."""
    rows = lay_out(pairs, key, order[0])
    rows = row_index(rows, key, order, "_pos")
    r = F.col("r_k")
    half = window // 2
    if method == "std":
        aggs = {"_disp": lambda w: F.stddev_samp(r).over(w)}
    else:
        aggs = {f"_h{i}": (lambda i: lambda w: F.count(F.when(unit_bin(r, BINS) == i, 1)).over(w))(i) for i in range(BINS)}
    aggs |= {"_n": lambda w: F.count(F.lit(1)).over(w), "_centre": lambda w: F.nth_value("cycle_ms", half + 1).over(w)}
    rows = framed(rows, key, order, aggs, 0, window - 1)
    disp = F.col("_disp") if method == "std" else entropy([F.col(f"_h{i}") for i in range(BINS)], 2.0)
    over = rows.filter((F.col("_n") == window) & (disp > threshold))
    first = over.groupBy(key).agg(F.min_by(F.struct("_centre", "_pos"), "_pos").alias("_f"))
    return rows.select(key).distinct().join(first, key, "left").select(
        key, F.col("_f._centre").alias("boundary_ms"), (F.col("_f._pos") - 1 + half).alias("boundary_idx"))


def raster_order(pairs: DataFrame, *, key: str = "grp", order: Sequence[str] = ("cycle_ms", "recording", "event_id")) -> DataFrame:
    """Row number in cycle order with mirrored short and long coordinates."""
    rows = row_index(lay_out(pairs, key, order[0]), key, order, "_pos")
    return rows.withColumns({"y": F.col("_pos") - 1, "x_short": -F.col("short_ms"), "x_long": F.col("long_ms")}).drop("_pos")


def display_order(groups: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rank of each present group: the wanted list first, then the rest by name.

    The rank is the count of present groups that come before, so the list of groups needs no single-task sort.
    """
    listed = F.array_position(F.array(*[F.lit(g) for g in wanted]), F.col("grp")) if wanted else F.lit(0)
    rows = groups.select("grp").distinct().withColumn("_all", F.lit(0)).withColumn("_w", listed.cast("int"))
    rows = rows.withColumn("_first", F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(len(wanted) + 1)))
    layout = plan_layout(rows, "_all", "_first")
    ranked = row_index(layout.mark(rows), "_all", ["_first", "grp"], "position")
    return ranked.select("grp", "position")


def gaussian_density(rows: DataFrame, value: str, grid: Sequence[float], *, key: str = "grp", bandwidth: float | None = None) -> DataFrame:
    """Kernel density at fixed grid points; kernel width is the sample deviation times n^(-1/5) or the given factor.

    Each value meets a constant number of grid points; a batch sends one array per key.
    """
    stats = rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_s"))
    factor = F.lit(float(bandwidth)) if bandwidth else F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = stats.filter("_n > 1 AND _s > 0").withColumn("_h", F.col("_s") * factor)
    points = rows.select(key, F.col(value).alias("_v")).filter("_v IS NOT NULL").join(stats, key)
    xs = np.array([float(g) for g in grid])

    def kernel(v: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (xs - v[:, None]) / h[:, None]
        return (np.exp(-0.5 * z * z) / (h * SQRT_2PI * n)[:, None]).sum(0)

    return _cell_sums(points, key, ["_v", "_h", "_n"], {"x": xs}, kernel)


def within_range(rows: DataFrame, column: str, limits: tuple[float, float]) -> DataFrame:
    """Rows whose value lies between the limits of an axis; points outside it do not count."""
    return rows.filter(F.col(column).between(*[float(x) for x in limits]))


def gaussian_density_2d(rows: DataFrame, x: str, y: str, xs: Sequence[float], ys: Sequence[float], *, factor: float,
                        key: str = "grp") -> DataFrame:
    """Two-dimensional kernel density on a fixed grid with the sample covariance scaled by factor squared."""
    stats = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"),
                                  F.covar_samp(x, y).alias("_c"))
    det = F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c")
    f2 = factor * factor
    stats = stats.filter("_n > 2").withColumn("_det", det).filter("_det > 0")
    points = rows.select(key, F.col(x).alias("_x"), F.col(y).alias("_y")).join(stats, key)
    cells = {"x": np.repeat([float(g) for g in xs], len(ys)), "y": np.tile([float(g) for g in ys], len(xs))}

    def kernel(u: np.ndarray, v: np.ndarray, vx: np.ndarray, vy: np.ndarray, c: np.ndarray, det: np.ndarray, n: np.ndarray) -> np.ndarray:
        dx, dy = cells["x"] - u[:, None], cells["y"] - v[:, None]
        quad = (vy[:, None] * dx * dx - 2 * c[:, None] * dx * dy + vx[:, None] * dy * dy) / (det * f2)[:, None]
        return (np.exp(-0.5 * quad) / (SQRT_2PI * SQRT_2PI * f2 * np.sqrt(det) * n)[:, None]).sum(0)

    return _cell_sums(points.filter("_x IS NOT NULL AND _y IS NOT NULL"), key, ["_x", "_y", "_vx", "_vy", "_c", "_det", "_n"], cells, kernel)


#: Kernel values (rows times cells) held at a time by a task.
KERNEL_VALUES = 1 << 20


def _cell_sums(points: DataFrame, key: str, columns: Sequence[str], cells: dict[str, np.ndarray], kernel: Callable[..., np.ndarray]) -> DataFrame:
    """Density per key and grid cell: `kernel` sums some rows of a key over all cells, and one array per key leaves a batch."""
    size = len(next(iter(cells.values())))
    step = max(1, KERNEL_VALUES // size)
    partial = T.StructType([points.schema[key], T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False):
                values, total = [part[c].to_numpy(dtype=float) for c in columns], np.zeros(size)
                for i in range(0, len(part), step):
                    total += kernel(*[v[i:i + step] for v in values])
                yield pd.DataFrame({key: [k], "_sums": [total]})

    at = F.col("_cell") + 1
    sums = points.select(key, *columns).mapInPandas(run, partial).select(key, F.posexplode("_sums").alias("_cell", "_value"))
    places = {n: F.element_at(F.array(*[F.lit(float(g)) for g in v]), at).alias(n) for n, v in cells.items()}
    return sums.groupBy(key, "_cell").agg(F.sum("_value").alias("density")).select(key, *places.values(), "density")
