"""Scalar numeric expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Round for output; removes the sign of zero so that results compare bit by bit."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def finite(c: Column | str, digits: int = 6) -> Column:
    """Rounded value, or null when it is not a finite number."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, tidy(c, digits))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def decibel(c: Column, floor: float = 1e-10) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(c, F.lit(floor)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# Fixed values of the Slaney mel scale: linear below 1 kHz, 27 log steps per factor 6.4 above.
MEL_STEP_HZ = 200.0 / 3.0
MEL_BREAK_HZ = 1000.0
MEL_LOG_STEPS = 27.0
MEL_LOG_FACTOR = 6.4


def hz_to_mel(hz: Column) -> Column:
    knee = MEL_BREAK_HZ / MEL_STEP_HZ
    upper = F.lit(knee) + F.log(F.greatest(hz, F.lit(MEL_BREAK_HZ)) / MEL_BREAK_HZ) * (
        MEL_LOG_STEPS / F.log(F.lit(MEL_LOG_FACTOR)))
    return F.when(hz < MEL_BREAK_HZ, hz / MEL_STEP_HZ).otherwise(upper)


def mel_to_hz(mel: Column) -> Column:
    knee = MEL_BREAK_HZ / MEL_STEP_HZ
    upper = F.lit(MEL_BREAK_HZ) * F.exp((F.log(F.lit(MEL_LOG_FACTOR)) / MEL_LOG_STEPS) * (mel - knee))
    return F.when(mel < knee, mel * MEL_STEP_HZ).otherwise(upper)


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Two-point table lookup, clipped at both ends."""
    share = F.least(F.greatest((x - x0) / F.lit(float(x1 - x0)), F.lit(0.0)), F.lit(1.0))
    return F.lit(float(y0)) + share * F.lit(float(y1 - y0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def positive_rise(now: Column, before: Column) -> Column:
    """Sum of the positive element-wise increases from `before` to `now`."""
    return F.aggregate(
        F.zip_with(now, before, lambda x, y: F.greatest(x.cast("double") - y.cast("double"), F.lit(0.0))),
        F.lit(0.0), lambda s, v: s + v)


def unit_bin(r: Column, bins: int) -> Column:
    """Histogram bin of a value in [0, 1]; the last bin is closed."""
    return F.least(F.floor(r * bins), F.lit(bins - 1)).cast("int")


# Fixed values of the draw generator: a prime modulus and two odd offsets.
DRAW_MODULUS = 2_147_483_647
DRAW_OFFSET = 40_503


def draw(seed: int, rep: Column, item: Column) -> Column:
    """Reproducible integer in [0, DRAW_MODULUS) for (seed, rep, item), computed with plain 64-bit arithmetic."""
    def stir(x: Column) -> Column:
        return (x * (x + F.lit(DRAW_OFFSET).cast("long"))) % F.lit(DRAW_MODULUS).cast("long")
    rep, item = rep.cast("long"), item.cast("long")
    a = stir((F.lit(seed).cast("long") + rep * F.lit(104_729).cast("long")) % F.lit(DRAW_MODULUS).cast("long"))
    b = stir((a + item * F.lit(1_299_709).cast("long")) % F.lit(DRAW_MODULUS).cast("long"))
    return stir((stir((b + a) % F.lit(DRAW_MODULUS).cast("long")) + item) % F.lit(DRAW_MODULUS).cast("long"))


def wide_draw(seed: int, rep: Column, item: Column) -> Column:
    """Two draws in one integer below 2^62, for positions and orders among very many items."""
    return draw(seed, rep, item) * F.lit(DRAW_MODULUS).cast("long") + draw(seed + 1, rep, item)


def wide_draw_array(seed: int, rep: int, item: np.ndarray) -> np.ndarray:
    """The same numbers as `wide_draw` for an int64 array of items."""
    def stir(x):
        return (x * (x + DRAW_OFFSET)) % DRAW_MODULUS

    def one(seed: int) -> np.ndarray:
        a = stir((seed + rep * 104_729) % DRAW_MODULUS)
        b = stir((a + item * 1_299_709) % DRAW_MODULUS)
        return stir((stir((b + a) % DRAW_MODULUS) + item) % DRAW_MODULUS)

    return one(seed) * DRAW_MODULUS + one(seed + 1)


def wide_draw_sql(seed: int, rep: str, item: str) -> str:
    return f"({draw_sql(seed, rep, item)} * {DRAW_MODULUS} + {draw_sql(seed + 1, rep, item)})"


def draw_sql(seed: int, rep: str, item: str) -> str:
    """The same generator as a SQL expression."""
    m, c = DRAW_MODULUS, DRAW_OFFSET
    stir = lambda x: f"((({x})::BIGINT * (({x})::BIGINT + {c})) % {m})"
    a = stir(f"({seed} + ({rep})::BIGINT * 104729) % {m}")
    b = stir(f"({a} + ({item})::BIGINT * 1299709) % {m}")
    return stir(f"({stir(f'({b} + {a}) % {m}')} + ({item})::BIGINT) % {m}")


def sample_bounds(frame: Column, total: Column, hop: int, window: int) -> list[Column]:
    """First, centre and last sample of a frame's window, inside the clip."""
    centre = frame * hop
    return [F.greatest(centre - window // 2, F.lit(0)).alias("sample_start"), centre.alias("sample_center"),
            F.least(centre + window // 2, total).alias("sample_end")]
