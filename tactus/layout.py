"""Ordered work on keyed sequences that survives one key holding most of the rows.

A window partitioned by `recording` runs each recording in one task. That is the best plan while every
recording is of moderate size, so it is the plan used by default. `plan_layout` measures the key sizes
(one count over the key column, combined map-side). Keys above `hot_rows` get their rows divided into
*runs*: value ranges of the ordering column between approximate quantiles. The run number depends on the
row's own values only, so it is stable under recomputation and needs neither a checkpoint nor a shuffle.

The helpers below leave ordinary keys to the plain window. They write the rows of oversized keys to reliable
storage once per step, because those are read twice (rows and run boundaries): the plan then grows by a constant
per step instead of doubling. Those rows are partitioned by (key, run) and a small carry passes between runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tactus.session import settled

RUN = "_run"
HOT_ROWS = 1_000_000
QUANTILE_ROWS = 200_000
RUN_ROWS = 500_000
MAX_RUNS = 10_000
MAX_LISTED_KEYS = 1_000


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


@dataclass(frozen=True)
class Layout:
    """Which keys are oversized and where their ordering column is cut."""

    keys: tuple[str, ...]
    order: str
    cuts: tuple[float, ...] = ()
    hot: tuple[tuple, ...] | None = ()
    largest: int = 0
    parts: int = 1

    @property
    def split(self) -> bool:
        return bool(self.cuts)

    def mark(self, df: DataFrame, order: str | None = None) -> DataFrame:
        """Add the run number; a no-op when no key is oversized."""
        if not self.split:
            return df
        edges = [float("-inf"), *self.cuts, float("inf")]
        wide = df.withColumn("_pos", F.col(order or self.order).cast("double"))
        wide = Bucketizer(splits=edges, inputCol="_pos", outputCol="_bucket", handleInvalid="keep").transform(wide)
        step = F.lit(0).cast("long")
        if self.parts > 1:
            # Even steps inside a range of values refine it further; the order of the runs still follows the values.
            cuts = F.array(*[F.lit(c) for c in (self.cuts[0], *self.cuts, self.cuts[-1])])
            at = F.least(F.col("_bucket").cast("int") + 1, F.lit(len(self.cuts) + 1))
            low, high = F.element_at(cuts, at), F.element_at(cuts, at + 1)
            share = F.coalesce((F.col("_pos") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
            step = F.when(F.isnan("_pos"), step).otherwise(
                F.least(F.greatest(F.floor(share * self.parts), F.lit(0)), F.lit(self.parts - 1)))
        # Rows without an order come first and NaN last, as in sorting: run 1, and the bucket after all others.
        run = F.when(F.col("_pos").isNull(), F.lit(1).cast("long")).otherwise(F.col("_bucket").cast("long") * self.parts + step + 2)
        if self.hot is not None:
            if len(self.keys) > 1:
                listed = F.struct(*self.keys).isin([F.struct(*[F.lit(v) for v in key]) for key in self.hot])
            else:
                key = F.col(self.keys[0])
                listed = key.isin([k for k, in self.hot if k is not None]) if any(k is not None for k, in self.hot) else F.lit(False)
                listed = F.coalesce(listed, F.lit(False)) | (key.isNull() if (None,) in self.hot else F.lit(False))
            run = F.when(listed, run).otherwise(F.lit(0).cast("long"))
        return wide.withColumn(RUN, run).drop("_pos", "_bucket")


def plan_layout(df: DataFrame, keys: str | Sequence[str], order: str, *, hot_rows: int = HOT_ROWS,
                run_rows: int = RUN_ROWS) -> Layout:
    """Measure key sizes and choose the cuts."""
    keys = as_list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    head = sizes.orderBy(F.desc("_n")).limit(MAX_LISTED_KEYS + 1).collect()
    largest = head[0]["_n"] if head else 0
    if largest <= hot_rows:
        return Layout(tuple(keys), order, largest=largest)
    hot = [row for row in head if row["_n"] > hot_rows]
    listed = len(hot) <= MAX_LISTED_KEYS
    rows = df
    if listed:
        total = sum(row["_n"] for row in hot)
        probe = Layout(tuple(keys), order, cuts=(0.0,), hot=tuple(tuple(row[k] for k in keys) for row in hot))
        rows = probe.mark(df).filter(F.col(RUN) > 0)
    else:
        total = df.count()
    wanted = max(2, -(-total // run_rows))
    runs = min(MAX_RUNS, wanted)
    probs = [i / runs for i in range(1, runs)]
    cuts = rows.select(F.col(order).cast("double").alias(order)).approxQuantile(order, probs, 1.0 / (4 * runs))
    cuts = tuple(sorted(set(cuts)))
    return Layout(tuple(keys), order, cuts=cuts, largest=largest, parts=-(-wanted // runs),
                  hot=tuple(tuple(row[k] for k in keys) for row in hot) if listed else None)


def lay_out(df: DataFrame, keys: str | Sequence[str], order: str, **sizes: int) -> DataFrame:
    return plan_layout(df, keys, order, **sizes).mark(df)


def plain(df: DataFrame) -> DataFrame:
    """Drop the run column before results leave the library."""
    return df.drop(RUN)


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same name, a null key matching a null key."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and the written rows of oversized keys."""
    return df.filter(F.col(RUN) == 0), settled(df.filter(F.col(RUN) > 0))


def _specs(order: Sequence[str], reverse: bool = False) -> list[Column]:
    return [F.desc(c) if reverse else F.asc(c) for c in order]


def shift(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
          cols: Mapping[str, tuple[str | Column, int]]) -> DataFrame:
    """Add neighbours: offset -1 is the previous row, +1 the next, and so on.

    With runs, rows at least `reach` away from both ends of their run are finished inside the run. Only the
    rows near a run's ends are ordered once more per key, at most 2*reach rows per (key, run).
    """
    keys, order = as_list(keys), as_list(order)

    def apply(frame: DataFrame, window) -> DataFrame:
        return frame.withColumns({
            name: F.lag(c, -k).over(window) if k < 0 else F.lead(c, k).over(window)
            for name, (c, k) in cols.items()
        })

    whole = Window.partitionBy(*keys).orderBy(*_specs(order))
    if RUN not in df.columns:
        return apply(df, whole)
    cold, df = _parts(df)
    cold = apply(cold, whole)
    reach = max(abs(k) for _, k in cols.values())
    inner = Window.partitionBy(*keys, RUN).orderBy(*_specs(order))
    here = apply(df, inner).withColumns({"_head": F.lag(F.lit(1), reach).over(inner).isNull(),
                                         "_tail": F.lead(F.lit(1), reach).over(inner).isNull()})
    edge = F.col("_head") | F.col("_tail")
    inside = here.filter(~edge)
    across = here.filter(edge).withColumns({
        f"_across_{name}": F.lag(c, -k).over(whole) if k < 0 else F.lead(c, k).over(whole)
        for name, (c, k) in cols.items()})
    across = across.withColumns({
        name: F.when(F.col("_head" if k < 0 else "_tail"), F.col(f"_across_{name}")).otherwise(F.col(name))
        for name, (_, k) in cols.items()}).drop(*[f"_across_{name}" for name in cols])
    return cold.unionByName(inside.unionByName(across).drop("_head", "_tail"))


def framed(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
           aggs: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int) -> DataFrame:
    """Aggregates over the rows from `before` preceding to `after` following; exact across runs.

    A negative bound lies on the other side, so (9, -2) is the ninth to the second preceding row.
    """
    keys, order = as_list(keys), as_list(order)
    frame = lambda *by: Window.partitionBy(*by).orderBy(*_specs(order)).rowsBetween(-before, after)
    if RUN not in df.columns:
        return df.withColumns({name: fn(frame(*keys)) for name, fn in aggs.items()})
    cold, df = _parts(df)
    cold = cold.withColumns({name: fn(frame(*keys)) for name, fn in aggs.items()})
    inner = Window.partitionBy(*keys, RUN).orderBy(*_specs(order))
    short = lambda far, k: far(F.lit(1), k).over(inner).isNull() if k > 0 else F.lit(False)
    reach = max(before, 0) + max(after, 0)
    here = df.withColumns({name: fn(frame(*keys, RUN)) for name, fn in aggs.items()}).withColumns({
        "_cut": short(F.lag, before) | short(F.lead, after),
        "_near": short(F.lag, reach) | short(F.lead, reach)})
    inside = here.filter(~F.col("_cut"))
    across = here.filter("_near").drop(*aggs)
    across = across.withColumns({name: fn(frame(*keys)) for name, fn in aggs.items()}).filter("_cut")
    return cold.unionByName(inside.unionByName(across).drop("_cut", "_near"))


_COMBINE = {
    "sum": lambda carry, value: F.when(carry.isNull(), value).otherwise(carry + F.coalesce(value, F.lit(0))),
    "max": lambda carry, value: F.greatest(carry, value),
    "min": lambda carry, value: F.least(carry, value),
}


def running(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
            aggs: Mapping[str, tuple[str, str | Column]], *, reverse: bool = False) -> DataFrame:
    """Running sum / max / min up to and including the current row (from the other end if `reverse`)."""
    keys, order = as_list(keys), as_list(order)
    prefix = (Window.unboundedPreceding, Window.currentRow)
    window = Window.partitionBy(*keys).orderBy(*_specs(order, reverse)).rowsBetween(*prefix)
    over = lambda frame, w: frame.withColumns({a: getattr(F, fn)(c).over(w) for a, (fn, c) in aggs.items()})
    if RUN not in df.columns:
        return over(df, window)
    cold, df = _parts(df)
    cold = over(cold, window)
    inner = Window.partitionBy(*keys, RUN).orderBy(*_specs(order, reverse)).rowsBetween(*prefix)
    here = over(df, inner)
    totals = df.groupBy(*keys, RUN).agg(
        *[getattr(F, fn)(c).alias(f"_tot_{a}") for a, (fn, c) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(*_specs([RUN], reverse)).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, RUN, *[
        getattr(F, fn)(f"_tot_{a}").over(before).alias(f"_carry_{a}") for a, (fn, _) in aggs.items()])
    joined = matched(here, carry, [*keys, RUN], "left")
    joined = joined.withColumns({
        a: _COMBINE[fn](F.col(f"_carry_{a}"), F.col(a)) for a, (fn, _) in aggs.items()})
    return cold.unionByName(joined.select(*df.columns, *aggs))


def row_index(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], name: str) -> DataFrame:
    """1-based position inside the key, exact across runs."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})


def nearest(left: DataFrame, right: DataFrame, key: str | Sequence[str], lt: str, rt: str,
            take: Sequence[str] = (), *, layout: Layout | None = None, tie: str = "earlier",
            name: str = "near", accept: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nearest right row in time for every left row, without forming pairs.

    With `accept`, a condition on the left row (`_t`) and a candidate, only accepted ones of the two candidates count.

    Both sides are merged in time order; a running max of past right rows and a running min of future right
    rows give the two candidates. Adds `<name>` (struct of the right time and the taken columns, null when the
    key has no right rows). A tie goes to the earlier or the later candidate.
    """
    key = as_list(key)
    payload = F.struct(F.col(rt).cast("double").alias("t"), *take)
    points = left.drop(RUN).select(
        *key, F.col(lt).cast("double").alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[c for c in left.columns if c != RUN]).alias("_row"))
    marks = right.select(*key, F.col(rt).cast("double").alias("_t"), F.lit(0).alias("_side"), payload.alias("_mark"))
    both = points.unionByName(marks, allowMissingColumns=True)
    if layout is not None and layout.split:
        both = layout.mark(both, "_t")
    both = running(both, key, ["_t", "_side"], {"_prev": ("max", "_mark")})
    both = running(both, key, ["_t", "_side"], {"_next": ("min", "_mark")}, reverse=True)
    if accept:
        both = both.withColumns({c: F.when(accept(F.col(c)), F.col(c)) for c in ("_prev", "_next")})
    back = F.col("_t") - F.col("_prev.t")
    ahead = F.col("_next.t") - F.col("_t")
    closer = (back <= ahead) if tie == "earlier" else (back < ahead)
    best = (F.when(F.col("_next").isNull(), F.col("_prev"))
            .when(F.col("_prev").isNull(), F.col("_next"))
            .when(closer, F.col("_prev")).otherwise(F.col("_next")))
    keep = [RUN] if RUN in both.columns else []
    return both.filter(F.col("_side") == 1).select("_row.*", best.alias(name), *keep)


def covered(points: DataFrame, spans: DataFrame, key: str | Sequence[str], t: str, start: str, end: str, name: str,
            *, layout: Layout | None = None) -> DataFrame:
    """Flag points lying in at least one closed span, by a sweep: the latest end among spans already begun."""
    key = as_list(key)
    left = points.drop(RUN).select(
        *key, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[c for c in points.columns if c != RUN]).alias("_row"))
    right = spans.select(*key, F.col(start).cast("double").alias("_t"), F.lit(0).alias("_side"),
                         F.col(end).cast("double").alias("_end"))
    both = left.unionByName(right, allowMissingColumns=True)
    if layout is not None and layout.split:
        both = layout.mark(both, "_t")
    both = running(both, key, ["_t", "_side"], {"_reach": ("max", "_end")})
    keep = [RUN] if RUN in both.columns else []
    return both.filter(F.col("_side") == 1).select(
        "_row.*", F.coalesce(F.col("_reach") >= F.col("_t"), F.lit(False)).alias(name), *keep)


def around(points: DataFrame, frames: DataFrame, key: str | Sequence[str], pt: str, ft: str, half: float,
           how: str = "inner") -> DataFrame:
    """Pair each point with the frames at most `half` seconds away.

    Equi-join on (key, time bucket); a point visits two buckets (three by rounding), so the output is points times frames
    per window, never all pairs of a key. Column names of both sides must differ except for the key.
    """
    key = as_list(key)
    points, frames = points.drop(RUN), frames.drop(RUN)
    width = 2.0 * half
    bucket = lambda c: F.floor(c / F.lit(width))
    lo, hi = bucket(F.col(pt) - half), bucket(F.col(pt) + half)
    left = points.withColumn("_b", F.explode(F.sequence(lo, hi)))
    right = frames.withColumn("_b", bucket(F.col(ft)))
    near = (F.col(ft) >= F.col(pt) - half) & (F.col(ft) <= F.col(pt) + half)
    joined = left.join(right, [*key, "_b"], "inner").filter(near).drop("_b")
    if how == "inner":
        return joined
    ids = points.columns
    extra = [c for c in frames.columns if c not in key]
    matched = joined.select(*ids, *extra)
    missing = points.select(*ids).join(joined.select(*ids).distinct(), ids, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True)


def dyadic_nodes(first: Column, last: Column) -> Column:
    """The fewest aligned power-of-two blocks that together are the buckets first to last: an array of (level, node).

    A level holds at most two of them, so a range of n buckets has at most 2 log2(n) + 2.
    """
    shift_right = lambda x, level: F.call_function("shiftright", x, level)
    lo, hi = first.cast("long"), last.cast("long") + 1
    levels = F.sequence(F.lit(0), F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int"))

    def at(level: Column) -> Column:
        a, b = -shift_right(-lo, level), shift_right(hi, level)
        inner = a + F.pmod(a, F.lit(2))
        node = lambda x: F.struct(level.alias("level"), x.alias("node"))
        return F.array(F.when((F.pmod(a, F.lit(2)) == 1) & (a < b), node(a)), F.when((F.pmod(b, F.lit(2)) == 1) & (inner < b), node(b - 1)))

    return F.array_compact(F.flatten(F.transform(levels, at)))


def within_spans(spans: DataFrame, frames: DataFrame, key: str, start: str, end: str, ft: str, width: float) -> DataFrame:
    """Pair each closed span with the frames inside it, by equi-join on (key, dyadic node of time buckets).

    A span goes to the few nodes that make it up, a frame to its own node on each level that spans of its key use.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    left = spans.drop(RUN).filter(F.col(end) >= F.col(start)).withColumn("_n", F.explode(dyadic_nodes(bucket(start), bucket(end))))
    left = left.select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    levels = left.groupBy(key).agg(F.collect_set("_level").alias("_levels"))  # at most 64 numbers
    right = frames.drop(RUN).join(levels, key).withColumn("_level", F.explode("_levels")).drop("_levels")
    right = right.withColumn("_node", F.call_function("shiftright", bucket(ft).cast("long"), F.col("_level")))
    return left.join(right, [key, "_level", "_node"]).filter(F.col(ft).between(F.col(start), F.col(end))).drop("_level", "_node")


def exact_quantiles(df: DataFrame, keys: str | Sequence[str], value: str, probs: Sequence[float], name: str,
                    *, rule: str = "linear", hot_rows: int = QUANTILE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Exact quantiles per key as an array column.

    Equal values are combined first and written once, as the size check and the ranking both read them. `linear` interpolates between ranks; `upper` takes element floor(p*n).
    While every key has a moderate number of distinct values the built-in percentile serves; beyond that the
    ranks come from running counts over runs, so no task holds a whole key.
    """
    keys = as_list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    counted = settled(counted)
    layout = plan_layout(counted, keys, "_v", hot_rows=hot_rows, run_rows=run_rows)
    if rule == "linear" and not layout.split:
        return counted.groupBy(*keys).agg(F.percentile("_v", list(probs), F.col("_c")).alias(name))
    ranked = running(layout.mark(counted), keys, "_v", {"_cum": ("sum", "_c")})
    totals = ranked.groupBy(*keys).agg(F.max("_cum").alias("_n"))
    ranked = matched(ranked, totals, keys)
    picks, outs = [], []
    for i, p in enumerate(probs):
        if rule == "linear":
            pos = F.lit(float(p)) * (F.col("_n") - 1)
            lo, hi = F.floor(pos), F.ceil(pos)
        else:
            lo = hi = F.least(F.floor(F.lit(float(p)) * F.col("_n")), F.col("_n") - 1)
            pos = lo
        picks += [F.min(F.when(F.col("_cum") > lo, F.col("_v"))).alias(f"_lo{i}"),
                  F.min(F.when(F.col("_cum") > hi, F.col("_v"))).alias(f"_hi{i}"),
                  F.first(pos - lo).alias(f"_w{i}")]
        outs.append(F.col(f"_lo{i}") + F.col(f"_w{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, F.array(*outs).alias(name))


def average_ranks(df: DataFrame, keys: str | Sequence[str], value: str, *, hot_rows: int = HOT_ROWS,
                  run_rows: int = RUN_ROWS) -> DataFrame:
    """Distinct values per key with their count, tie-averaged rank and cumulative count.

    Columns: keys, `value`, `n_equal`, `cum`, `avg_rank`.
    """
    keys = as_list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_equal"))
    counted = settled(counted)
    layout = plan_layout(counted, keys, value, hot_rows=hot_rows, run_rows=run_rows)
    ranked = running(layout.mark(counted), keys, value, {"cum": ("sum", "n_equal")})
    return plain(ranked).withColumn(
        "avg_rank", F.col("cum") - F.col("n_equal") + (F.col("n_equal") + 1) / F.lit(2.0))
