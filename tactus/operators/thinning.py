"""Greedy spacing rules: each row is compared with the last row *kept*, not with its neighbour.

Small keys are folded inside the JVM, larger ones scanned in Arrow batches, and oversized keys run by run through
transition maps (`chains`). Rows without a time take no part in a spacing or bridging rule.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.layout import RUN, as_list
from tactus.operators.chains import Bridging, Spacing, chained, scanned
from tactus.session import reliable_folder

FOLD_ROWS = 4_000


def _spaced_in_arrays(df: DataFrame, keys, t, gap, inclusive, strength, ties) -> DataFrame:
    rest = [c for c in df.columns if c not in {*keys, t, *ties, RUN}]
    rows = F.sort_array(F.collect_list(F.struct(t, *ties, *rest)))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows"))
    one_gap = (lambda x: x[gap]) if isinstance(gap, str) else (lambda x: F.lit(float(gap)))

    def step(kept, row):
        last = F.element_at(kept, -1)
        dist = row[t] - last[t]
        fresh = dist >= one_gap(row) if inclusive else dist > one_gap(row)
        out = F.when(fresh, F.concat(kept, F.array(row)))
        if strength:
            out = out.when(row[strength] > last[strength],
                           F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(row)))
        return out.otherwise(kept)

    folded = F.aggregate(F.slice("_rows", 2, F.size("_rows")), F.slice("_rows", 1, 1), step)
    return grouped.select(*keys, F.explode(folded).alias("_k")).select(*keys, "_k.*").select(
        *[c for c in df.columns if c != RUN])


def _scan_dips(levels, valleys, dip, start, start_low):
    """Keep maxima parted by a dip on both sides, else the louder one. Also returns the lowest level since the open row."""
    done: list[int] = []
    open_row, last, low = (-1, start, start_low) if start is not None else (None, None, None)
    for i, level in enumerate(levels):
        if open_row is None:
            open_row, last, low = i, level, float("inf")
            continue
        low = min(low, valleys[i])
        if last - low >= dip and level - low >= dip:
            done.append(open_row)
            open_row, last, low = i, level, float("inf")
        elif level > last:
            open_row, last, low = i, level, float("inf")
    return done, open_row, low


def _in_runs(df: DataFrame, keys: list[str], rule: Spacing | Bridging, ties: list[str]) -> DataFrame:
    """Kept rows: keys in run 0 are scanned whole, divided keys through transition maps."""
    if RUN not in df.columns:
        return scanned(df, keys, rule, ties)
    kept = scanned(df.filter(F.col(RUN) == 0).drop(RUN), keys, rule, ties)
    hot = df.filter(F.col(RUN) > 0)
    return kept if hot.isEmpty() else kept.unionByName(chained(hot, keys, rule, ties))


def _parted_in_runs(df: DataFrame, keys: list[str], order: str, fresh: str, level: str, dip: float) -> DataFrame:
    """Ordered Arrow scans per (key, run); the open maximum of each run is carried into the key's next run.

    Pass 1 finds each run's closing row. A run that contains a deep valley closes the same way whatever came
    before. The rare runs without one are settled in order, all keys at once. Pass 2 scans every run from the
    carried row. Only boundary rows travel between the passes.
    """
    columns = [c for c in df.columns if c != RUN]
    held = T.StructType([df.schema[c] for c in columns])
    if RUN not in df.columns:
        df = df.withColumn(RUN, F.lit(0).cast("long"))
    by = [*keys, RUN]
    body = df.select(*by, F.struct(*columns).alias("_row"))
    end_type = T.StructType([*[df.schema[c] for c in by], T.StructField("_end", held),
                             T.StructField("_settled", T.BooleanType())])

    def ordered(pdf: pd.DataFrame):
        rows = pd.DataFrame.from_records(pdf["_row"].tolist(), columns=columns)
        return rows.sort_values([order], kind="stable").reset_index(drop=True)

    def scan(rows: pd.DataFrame, carry):
        done, last, low = _scan_dips(rows[level].tolist(), rows["_valley"].tolist(), dip, carry[level] if carry else None,
                                     carry["_valley"] if carry else None)
        if last is not None and last >= 0:
            rows.loc[last, "_valley"] = low
        elif carry:
            carry["_valley"] = low
        return done, last

    def last_reset(rows: pd.DataFrame) -> int:
        """Last row at which the rule starts afresh whatever came before; 0 without one."""
        at = rows[fresh].astype(bool).iloc[1:].to_numpy().nonzero()[0]
        return int(at[-1]) + 1 if len(at) else 0

    def pick(rows: pd.DataFrame, i: int | None, carry):
        if i is None:
            return None
        return carry if i < 0 else _as_row(rows, i, columns)

    def close_alone(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = ordered(pdf)
        at = last_reset(rows)
        rest = rows.iloc[at:].reset_index(drop=True)
        _, last = scan(rest, None)
        return pdf[by].iloc[[0]].assign(_end=[pick(rest, last, None)], _settled=at > 0)

    def carried(pdf: pd.DataFrame):
        carry = pdf["_carry"].iloc[0]
        carry = dict(carry) if isinstance(carry, dict) else None
        rows = ordered(pdf)
        done, last = scan(rows, carry)
        return rows, carry, done, last

    def close_after(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, carry, _, last = carried(pdf)
        return pdf[by].iloc[[0]].assign(_end=[pick(rows, last, carry)], _settled=True)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, carry, done, last = carried(pdf)
        wanted = done + ([last] if bool(pdf["_final"].iloc[0]) else [])
        if not wanted:
            return pd.DataFrame()
        return pd.DataFrame.from_records([pick(rows, i, carry) for i in wanted], columns=columns)

    hot = F.col(RUN) > 0
    cold = body.filter(~hot).withColumns({"_carry": F.lit(None).cast(held), "_final": F.lit(True)})
    kept = cold.groupBy(*by).applyInPandas(finish, held)
    if RUN in columns or df.select(RUN).filter(hot).limit(1).count() == 0:
        return kept

    reliable_folder(df.sparkSession)
    long = body.filter(hot)
    along = Window.partitionBy(*keys).orderBy(RUN)
    ends = long.groupBy(*by).applyInPandas(close_alone, end_type)
    ends = ends.withColumn("_settled", F.col("_settled") | F.lag("_settled").over(along).isNull()).checkpoint()
    while True:
        before = ends.withColumns({"_carry": F.lag("_end").over(along),
                                   "_ready": F.lag("_settled").over(along)})
        todo = before.filter(~F.col("_settled") & F.col("_ready")).select(*by, "_carry")
        closed = long.join(todo, by).groupBy(*by).applyInPandas(close_after, end_type).checkpoint()
        if closed.limit(1).count() == 0:
            break
        ends = ends.join(closed, by, "left_anti").unionByName(closed).checkpoint()
    bounds = ends.select(*by, F.lag("_end").over(along).alias("_carry"),
                         F.lead("_settled").over(along).isNull().alias("_final"))
    more = long.join(bounds, by).groupBy(*by).applyInPandas(finish, held)
    return kept.unionByName(more)


def _as_row(rows: pd.DataFrame, i: int, columns: list[str]) -> dict:
    values = (rows[c].iat[i] for c in columns)
    return {c: None if pd.api.types.is_scalar(v) and pd.isna(v) else v for c, v in zip(columns, values, strict=True)}


def _largest(df: DataFrame, keys: list[str], at_most: int | None, limit: int) -> int:
    """Rows of the largest key, or a known bound that is small enough."""
    if at_most is not None and at_most <= limit:
        return at_most
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def spaced(df: DataFrame, keys: str | Sequence[str], t: str, gap: float | str, *, inclusive: bool = True,
           strength: str | None = None, ties: Sequence[str] = (), fold_rows: int = FOLD_ROWS,
           at_most: int | None = None) -> DataFrame:
    """Rows kept by the greedy spacing rule.

    A row is kept when its distance from the last kept row is >= gap (> gap if not `inclusive`). With `strength`
    a closer row replaces the last kept one when it is strictly stronger. `gap` may name a column of one value per key.
    Small keys are folded inside the JVM; the array copy is quadratic, so larger keys use ordered Arrow scans,
    divided by run when the key is oversized. `at_most` is a known bound of the rows per key, which spares the count.
    """
    keys, ties, df = as_list(keys), list(ties), df.filter(F.col(t).isNotNull())
    if fold_rows:
        if _largest(df, keys, at_most, fold_rows) <= fold_rows:
            return _spaced_in_arrays(df, keys, t, gap, inclusive, strength, ties)
    return _in_runs(df, keys, Spacing(t, gap, inclusive, strength), ties)


def parted_by_dips(df: DataFrame, keys: str | Sequence[str], order: str, level: str, fresh: str, dip: float) -> DataFrame:
    """Maxima (rows with their level and `_valley`, the lowest level since the previous one) parted by dips of at least
    `dip` on both sides; otherwise the louder stays. `fresh` names a flag for valleys that any maximum clears.
    """
    return _parted_in_runs(df, as_list(keys), order, fresh, level, dip)


def bridged(df: DataFrame, keys: str | Sequence[str], t: str, base: str, dup: float, reach: float, *,
            ties: Sequence[str] = (), fold_rows: int = FOLD_ROWS, at_most: int | None = None) -> DataFrame:
    """Rows accepted in time order when the nearest of (fixed set, rows accepted so far) is in (dup, reach].

    `base` holds the distance to the fixed set (infinity when it is empty).
    """
    keys, ties, df = as_list(keys), list(ties), df.filter(F.col(t).isNotNull())
    if not fold_rows or _largest(df, keys, at_most, fold_rows) > fold_rows:
        return _in_runs(df, keys, Bridging(t, base, dup, reach), ties)
    rest = [c for c in df.columns if c not in {*keys, t, *ties, RUN}]
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(t, *ties, *rest))).alias("_rows"))

    def step(kept, row):
        dist = F.least(row[base], row[t] - F.try_element_at(kept, F.lit(-1))[t])
        return F.when((dist > dup) & (dist <= reach), F.concat(kept, F.array(row))).otherwise(kept)

    folded = F.aggregate("_rows", F.slice("_rows", 1, 0), step)
    return grouped.select(*keys, F.explode(folded).alias("_k")).select(*keys, "_k.*").select(
        *[c for c in df.columns if c != RUN])
