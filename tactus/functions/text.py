"""String, list-text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_times(text: Column) -> Column:
    """'[0.2, 0.8; 1.4]' -> ascending array<double>; tokens that are not finite numbers are skipped."""
    bare = F.regexp_replace(text, r"[\[\]\(\)]", " ")
    nums = F.transform(F.split(bare, r"[,;\s]+"), lambda s: F.expr("0D") + s.try_cast("double"))
    keep = F.filter(nums, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.array_sort(F.coalesce(keep, F.array().cast("array<double>")))


def fixed(value: Column | str, digits: int) -> Column:
    """Fixed decimals, halves to even as in most C-based formatting (the JVM formatter rounds them up)."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def format_times(times: Column, digits: int = 6) -> Column:
    return F.array_join(F.transform(F.array_sort(times), lambda x: fixed(x, digits)), ", ")


def base_name(path: Column) -> Column:
    """Last path segment, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1)))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_label(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9]", "_")


def clock(seconds: Column) -> Column:
    """Seconds as HH:MM:SS.mmm."""
    whole = F.floor(seconds).cast("long")
    ms = F.round((seconds - whole) * 1000).cast("long")
    carry = F.when(ms >= 1000, 1).otherwise(0)
    whole, ms = whole + carry, ms - carry * 1000
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600).cast("long"),
                           F.floor(whole % 3600 / 60).cast("long"), (whole % 60).cast("long"), ms)


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of all objects in order, types kept, for equality tests; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))
