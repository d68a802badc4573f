"""Greedy rules over the runs of an oversized key, as chains that are followed from all rows at once.

A greedy rule compares each row with the last row kept (its *state*). Whatever row is the state, the next row that
becomes the state is known: so inside a run every row points to a next one, and the rows without a next one in their
run are its *exits*. Few rows are exits, as chains that start at different rows soon share their rows.

1. Each run gives its exits (one pass).
2. An exit looks for the first later run that ends its wait. Runs are summed up in a pyramid of pairs, so the search takes
   at most two steps a level; nearly all find the next run at once.
3. The run found tells which row the exit leads to and at which exit the chain from there leaves the run (one pass).
   These are transition maps from exits to exits.
4. Maps are composed with themselves, 1, 2, 4, ... runs at a time, and mark the exits that the key's first row leads to.
5. Each run is read once more, from the row at which the marked chain enters it.

The number of jobs grows with the logarithm of the runs; only states travel, and every join is on (key, run).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactus.layout import RUN, matched
from tactus.session import settled

EPS = np.finfo(np.float64).eps


def first_after(times: np.ndarray, since: np.ndarray, gap: np.ndarray, inclusive: bool) -> np.ndarray:
    """Index of the first of the ordered times whose distance from `since` is >= gap (> gap if not inclusive).

    The sum only says where to begin; the distance itself decides, as it does in the plain scan.
    """
    if not len(times):
        return np.zeros(len(since), np.int64)
    with np.errstate(invalid="ignore"):
        limit = since + gap
        slack = 4 * EPS * (np.abs(since) + np.abs(gap) + np.abs(limit))
        at = np.searchsorted(times, np.where(np.isfinite(limit), limit - slack, limit))
        at[np.isnan(limit)] = len(times)
        while True:
            look = np.minimum(at, len(times) - 1)
            distance = times[look] - since
            short = (at < len(times)) & ~(distance >= gap if inclusive else distance > gap)
            if not short.any():
                return at
            at[short] += 1


@dataclass(frozen=True)
class Spacing:
    """A row far enough from the state is kept; with `strength` a closer, stronger row takes the state's place.

    The gap is one number per key.
    """

    t: str
    gap: float | str
    inclusive: bool = True
    strength: str | None = None

    def arrays(self, rows: pa.Table) -> dict[str, np.ndarray]:
        t = _floats(rows[self.t])
        gap = _floats(rows[self.gap]) if isinstance(self.gap, str) else np.full(len(t), float(self.gap))
        level = _floats(rows[self.strength]) if self.strength else np.zeros(len(t))
        return {"t": t, "gap": gap, "level": level}

    def follow(self, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each row the next state in the run (or the number of rows), and whether the row is kept before it."""
        n = len(a["t"])
        far = np.maximum(first_after(a["t"], a["t"], a["gap"], self.inclusive), np.arange(n) + 1)
        if not self.strength:
            return far, np.full(n, True)
        stronger, waiting, level = np.full(n, n), [], a["level"].tolist()
        for i, x in enumerate(level):
            while waiting and x > level[waiting[-1]]:
                stronger[waiting.pop()] = i
            if x == x:
                waiting.append(i)
        return np.minimum(far, stronger), far <= stronger

    def enter(self, a: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For states of earlier runs, the same as `follow`."""
        n, begins = len(a["t"]), np.isneginf(s["t"])
        far = first_after(a["t"], s["t"], s["gap"], self.inclusive)
        far[begins] = 0
        if not self.strength:
            return far, np.full(len(far), True)
        most = np.maximum.accumulate(np.where(np.isnan(a["level"]), -np.inf, a["level"])) if n else a["level"]
        stronger = np.searchsorted(most, s["level"], side="right")
        stronger[np.isnan(s["level"]) | begins] = n
        return np.minimum(far, stronger), far <= stronger

    def states(self, a: dict[str, np.ndarray]) -> np.ndarray:
        return np.full(len(a["t"]), True)

    def summary(self) -> dict[str, Column]:
        level = F.max(F.when(~F.isnan(F.col(self.strength).cast("double")), F.col(self.strength).cast("double"))) if self.strength else F.lit(None).cast("double")
        return {"most_t": F.max(F.col(self.t).cast("double")), "most_level": level}

    def pairs(self) -> dict[str, Column]:
        return {c: F.max(c).alias(c) for c in ("most_t", "most_level")}

    def holds(self) -> Column:
        """Whether a part of the pyramid ends the wait of a state."""
        distance = F.col("most_t") - F.col("t")
        far = distance >= F.col("gap") if self.inclusive else distance > F.col("gap")
        return F.coalesce(F.isnan("t") | (F.col("t") == float("-inf")) | far, F.lit(False)) | F.coalesce(F.col("most_level") > F.col("level"), F.lit(False))


@dataclass(frozen=True)
class Bridging:
    """A row is accepted when the nearer of the fixed set (`base` away) and the last accepted row is in (dup, reach]."""

    t: str
    base: str
    dup: float
    reach: float

    def arrays(self, rows: pa.Table) -> dict[str, np.ndarray]:
        t, base = _floats(rows[self.t]), _floats(rows[self.base])
        return {"t": t, "gap": np.full(len(t), self.dup), "level": base}

    def _next(self, a: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(s["t"]), len(a["t"]))
        near = (a["level"] > self.dup) & (a["level"] <= self.reach)
        for some, bound in ((np.flatnonzero(near), np.inf), (np.flatnonzero(a["level"] > self.reach), self.reach)):
            times = a["t"][some]
            at = first_after(times, s["t"], s["gap"], False)
            ok = at < len(some)
            if ok.any():
                at = np.where(ok, at, 0)
                with np.errstate(invalid="ignore"):
                    ok &= times[at] - s["t"] <= bound
                out = np.where(ok, np.minimum(out, some[at]), out)
        return out

    def follow(self, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return self._next(a, a), np.full(len(a["t"]), True)

    def enter(self, a: dict[str, np.ndarray], s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return self._next(a, s), np.full(len(s["t"]), True)

    def states(self, a: dict[str, np.ndarray]) -> np.ndarray:
        return a["level"] > self.dup

    def summary(self) -> dict[str, Column]:
        t, base = F.col(self.t).cast("double"), F.col(self.base)
        far = F.when(base > self.reach, t)
        return {"near_t": F.max(F.when((base > self.dup) & (base <= self.reach), t)), "far_t": F.max(far), "far_first": F.min(far)}

    def pairs(self) -> dict[str, Column]:
        return {"near_t": F.max("near_t").alias("near_t"), "far_t": F.max("far_t").alias("far_t"), "far_first": F.min("far_first").alias("far_first")}

    def holds(self) -> Column:
        t, dup = F.col("t"), F.col("gap")
        return F.coalesce(F.col("near_t") - t > dup, F.lit(False)) | F.coalesce((F.col("far_t") - t > dup) & (F.col("far_first") - t <= self.reach), F.lit(False))


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return pc.cast(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, pa.float64()).to_numpy(zero_copy_only=False).copy()


def _ordered(table: pa.Table, t: str, ties: Sequence[str]) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in (t, *ties)])


def _ends(nxt: np.ndarray) -> np.ndarray:
    """The exit that each row's chain leads to."""
    n = len(nxt)
    to = np.where(nxt < n, nxt, np.arange(n))
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def kept_rows(nxt: np.ndarray, kept: np.ndarray, entry: int, last_kept: bool) -> list[int]:
    """The rows of the chain from `entry` that are kept; the exit is if `last_kept` says so."""
    out, n, i, follow, keep = [], len(nxt), entry, nxt.tolist(), kept.tolist()
    while i < n:
        if keep[i] if follow[i] < n else last_kept:
            out.append(i)
        i = follow[i]
    return out


def scanned(df: DataFrame, keys: Sequence[str], rule: Spacing | Bridging, ties: Sequence[str]) -> DataFrame:
    """The kept rows of each key, one key in a task."""
    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table, rule.t, ties)
        a = rule.arrays(table)
        start = {"t": np.array([-np.inf]), "gap": a["gap"][:1], "level": np.array([np.nan])}
        entry = int(rule.enter(a, start)[0][0])
        return table.take(pa.array(kept_rows(*rule.follow(a), entry, True), pa.int64()))

    return df.groupBy(*keys).applyInArrow(run, df.schema)


STATE = "from_run long, idx long, t double, gap double, level double, node long"
EDGE = "from_run long, idx long, to_run long, entry long, exit long, kept boolean"


def _with_keys(rows: DataFrame, keys: Sequence[str], schema: str) -> T.StructType:
    return T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string(schema).fields])


def _keyed(table: pa.Table, keys: Sequence[str], columns: dict[str, np.ndarray]) -> pa.Table:
    n = len(next(iter(columns.values())))
    first = pa.array(np.zeros(n, np.int64))
    return pa.table({**{k: table[k].combine_chunks().take(first) if table.num_rows else table[k] for k in keys}, **{c: pa.array(v) for c, v in columns.items()}})


def _found(pending: DataFrame, pyramid: DataFrame, keys: Sequence[str], rule: Spacing | Bridging, levels: int, top: int) -> DataFrame | None:
    """States with the first run (`node`) from their node on that ends their wait; others are dropped."""
    out = None
    pending = settled(pending.withColumn("level_no", F.lit(0)))
    while not pending.isEmpty():
        parts = [c for c in pyramid.columns if c not in (*keys, "level_no", "node")]
        met = settled(matched(pending, pyramid, [*keys, "level_no", "node"], "left").withColumn("_holds", rule.holds()).drop(*parts))
        done = met.filter(F.col("_holds") & (F.col("level_no") == 0)).drop("_holds", "level_no")
        out = done if out is None else out.union(done)
        down = F.col("_holds")
        nxt, up = F.col("node") + 1, (F.col("node") % 2 == 1) & (F.col("level_no") < levels)
        pending = settled(met.filter(~F.col("_holds") | (F.col("level_no") > 0)).withColumns({
            "node": F.when(down, F.col("node") * 2).when(up, F.shiftright(nxt, 1)).otherwise(nxt),
            "level_no": F.when(down, F.col("level_no") - 1).when(up, F.col("level_no") + 1).otherwise(F.col("level_no"))}).filter(
                F.col("node") <= F.expr(f"shiftright({top}L, level_no)")).drop("_holds"))
    return out


def chained(df: DataFrame, keys: Sequence[str], rule: Spacing | Bridging, ties: Sequence[str]) -> DataFrame:
    """The kept rows of keys that are divided into runs (column `RUN`)."""
    by = [*keys, RUN]
    rows = settled(df)
    top = rows.agg(F.max(RUN)).first()[0] or 0
    levels = int(top).bit_length()

    def exits(table: pa.Table) -> pa.Table:
        a = rule.arrays(_ordered(table, rule.t, ties))
        at = np.flatnonzero((rule.follow(a)[0] == len(a["t"])) & rule.states(a))
        run = table[RUN][0].as_py()
        return _keyed(table, keys, {"from_run": np.full(len(at), run), "idx": at, **{c: a[c][at] for c in ("t", "gap", "level")}, "node": np.full(len(at), run + 1)})

    states = rows.groupBy(*by).applyInArrow(exits, _with_keys(rows, keys, STATE))
    gap = F.first(F.col(rule.gap).cast("double")) if isinstance(getattr(rule, "gap", None), str) else F.lit(float(getattr(rule, "gap", None) or getattr(rule, "dup", 0.0)))
    starts = rows.groupBy(*keys).agg(F.min(RUN).alias("node"), gap.alias("gap")).select(
        *keys, F.lit(-1).cast("long").alias("from_run"), F.lit(-1).cast("long").alias("idx"), F.lit(float("-inf")).alias("t"), "gap",
        F.lit(float("nan")).alias("level"), "node")
    summary = rows.groupBy(*by).agg(*[c.alias(name) for name, c in rule.summary().items()])
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level_no")
    pyramid = settled(summary.select("*", at).withColumn("node", F.expr(f"shiftright({RUN}, level_no)")).groupBy(*keys, "level_no", "node").agg(*rule.pairs().values()))

    def visit(some: pa.Table, table: pa.Table) -> pa.Table:
        if not some.num_rows:
            return _keyed(some, keys, {c: np.zeros(0, bool if c == "kept" else np.int64) for c in ("from_run", "idx", "to_run", "entry", "exit", "kept")})
        a = rule.arrays(_ordered(table, rule.t, ties))
        s = {c: _floats(some[c]) for c in ("t", "gap", "level")}
        entry, kept = rule.enter(a, s)
        end = np.append(_ends(rule.follow(a)[0]), -1)
        whole = lambda c: some[c].to_numpy()
        return _keyed(some, keys, {"from_run": whole("from_run"), "idx": whole("idx"), "to_run": whole("node"), "entry": np.where(entry < len(a["t"]), entry, -1),
                                   "exit": end[entry], "kept": kept})

    pending, edges = states.union(starts).filter(F.col("node") <= top), None
    while True:
        found = _found(pending, pyramid, keys, rule, levels, int(top))
        if found is None:
            break
        found = settled(found)
        met = settled(found.withColumn(RUN, F.col("node")).groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(visit, _with_keys(rows, keys, EDGE)))
        here = met.filter("entry >= 0")
        edges = here if edges is None else edges.union(here)
        # a run may look as if it ended a wait and yet have no such row
        passed = met.filter("entry < 0").select(*keys, "from_run", "idx")
        if passed.isEmpty():
            break
        pending = matched(found, passed, [*keys, "from_run", "idx"], "left_semi").withColumn("node", F.col("node") + 1).filter(F.col("node") <= top)
    if edges is None:
        return df.limit(0).drop(RUN)
    edges = settled(edges)

    spot, to = [*keys, "from_run", "idx"], [F.col("to_run").alias("from_run"), F.col("exit").alias("idx")]
    jump = edges.select(*spot, "to_run", "exit")
    marked = settled(edges.filter("idx = -1").select(*spot))
    while True:
        further = matched(jump, marked, spot, "left_semi").select(*keys, *to)
        more = settled(matched(further, marked, spot, "left_anti").distinct())
        if more.isEmpty():
            break
        marked = settled(marked.union(more))
        beyond = jump.select(*keys, F.col("from_run").alias("to_run"), F.col("idx").alias("exit"), F.col("to_run").alias("_run"), F.col("exit").alias("_exit"))
        jump = settled(matched(jump, beyond, [*keys, "to_run", "exit"]).select(*spot, F.col("_run").alias("to_run"), F.col("_exit").alias("exit")))
    visited = settled(matched(edges, marked, spot, "left_semi"))
    left = visited.select(*keys, F.col("from_run").alias("to_run"), F.col("kept").alias("last_kept"))
    entries = matched(visited.select(*keys, "to_run", "entry"), left, [*keys, "to_run"], "left").select(
        *keys, F.col("to_run").alias(RUN), "entry", F.coalesce("last_kept", F.lit(True)).alias("last_kept"))

    def finish(entry: pa.Table, table: pa.Table) -> pa.Table:
        table = _ordered(table, rule.t, ties)
        wanted = []
        if entry.num_rows:
            wanted = kept_rows(*rule.follow(rule.arrays(table)), entry["entry"][0].as_py(), entry["last_kept"][0].as_py())
        return table.select(columns).take(pa.array(wanted, pa.int64()))

    columns = [c for c in df.columns if c != RUN]
    return entries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(finish, T.StructType([df.schema[c] for c in columns]))
