"""Intervals between onsets and the overlapping pairs built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.layout import row_index, shift

KEY = "recording"
ORDER = ("t", "event_id")


def with_ioi(onsets: DataFrame, *, key: str = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """Milliseconds since the previous onset; null for the first."""
    rows = shift(onsets, key, order, {"_p": ("t", -1)})
    return rows.withColumn("ioi_ms", (F.col("t") - F.col("_p")) * 1000).drop("_p")


def rolling_ratio(onsets: DataFrame, *, key: str = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    """Ratio of the previous interval to the last two; null before the third onset or for a zero sum."""
    rows = shift(onsets, key, order, {"_p1": ("t", -1), "_p2": ("t", -2)})
    first, second = F.col("_p1") - F.col("_p2"), F.col("t") - F.col("_p1")
    total = first + second
    return rows.withColumn("rolling_rk", F.when(total > 0, first / total)).drop("_p1", "_p2")


def alike(a: Column, b: Column, tolerance: float) -> Column:
    """Relative difference within the tolerance; never for non-positive intervals."""
    longest = F.greatest(a, b)
    return (longest > 0) & (F.abs(a - b) / F.nullif(longest, F.lit(0.0)) <= tolerance)


def dyads(onsets: DataFrame, *, tolerance: float = 0.1, digits: tuple[int, int] | None = None, key: str = KEY,
          order: Sequence[str] = ORDER, index: bool = True) -> DataFrame:
    """Overlapping interval pairs with ratio and stability flag.

    One ordered pass yields the next four onsets. `digits` = (interval, ratio) rounding before later metrics.
    """
    rows = row_index(onsets, key, order, "dyad_index") if index else onsets
    rows = shift(rows, key, order, {f"_n{k}": ("t", k) for k in range(1, 5)})
    at = [F.col("t"), *[F.col(f"_n{k}") for k in range(1, 5)]]
    gap = [(at[i + 1] - at[i]) * 1000 for i in range(4)]
    has_third, has_fourth = F.col("_n3").isNotNull(), F.col("_n4").isNotNull()
    stable = (has_third & F.coalesce(alike(gap[0], gap[2], tolerance), F.lit(False))
              & (~has_fourth | F.coalesce(alike(gap[1], gap[3], tolerance), F.lit(False))))
    pairs = rows.filter(F.col("_n2").isNotNull()).withColumns({
        "interval_1_ms": gap[0], "interval_2_ms": gap[1], "stable": stable})
    keep = [c for c in onsets.columns if c not in ("strength", "layer")]
    extra = ["dyad_index"] if index else []
    return pair_columns(pairs.select(*keep, *extra, "interval_1_ms", "interval_2_ms", "stable"), digits)


def pair_columns(pairs: DataFrame, digits: tuple[int, int] | None = None) -> DataFrame:
    """Cycle, short, long and ratio of two neighbouring intervals."""
    one, two = F.col("interval_1_ms"), F.col("interval_2_ms")
    cycle = one + two
    cols = {"cycle_ms": cycle, "short_ms": F.least(one, two), "long_ms": F.greatest(one, two),
            "r_k": F.when(cycle > 0, one / F.nullif(cycle, F.lit(0.0))).otherwise(F.lit(0.0))}
    if digits:
        cols = {name: F.round(c, digits[1] if name == "r_k" else digits[0]) for name, c in cols.items()}
        cols |= {"interval_1_ms": F.round(one, digits[0]), "interval_2_ms": F.round(two, digits[0])}
    return pairs.withColumns(cols)


def valid_ratios(pairs: DataFrame, column: str = "r_k") -> DataFrame:
    """Numeric ratios strictly between 0 and 1."""
    value = F.col(column).try_cast("double")
    return pairs.withColumn(column, value).filter((value > 0) & (value < 1))


def isochronous(r: Column, low: float = 0.45, high: float = 0.55) -> Column:
    return r.between(low, high)


def with_tempo(pairs: DataFrame, mode: str = "ioi", low: float | None = None, high: float | None = None) -> DataFrame:
    """Beats per minute from the cycle; a zero cycle gives null. Optional closed range filter."""
    beat = 120_000.0 if mode == "ioi" else 60_000.0
    rows = pairs.withColumn("bpm", F.lit(beat) / F.nullif(F.col("cycle_ms"), F.lit(0.0)))
    return rows if low is None else rows.filter(F.col("bpm").between(low, high))


def without_range(onsets: DataFrame, start: float, end: float, tolerance: float = 0.0) -> DataFrame:
    """Drop onsets inside a closed time range, widened by the tolerance."""
    lo, hi = min(start, end) - tolerance, max(start, end) + tolerance
    return onsets.filter(~F.col("t").between(lo, hi))

