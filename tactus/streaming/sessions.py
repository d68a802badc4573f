"""Change events and revision states of sessions, as batch queries and as streams.

A state may carry `preferred_kind`, the kind that the caller wants for a changed asset; it holds unless the asset is gone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tactus.layout import lay_out, plain, row_index, running, shift

RETAINED = 256
POLL_LIMIT = 100
KINDS = ("asset", "transport/time_changed", "transport/selection_changed")
STATE = ("asset_id", "path", "revision_id", "status", "playhead", "selection")


def _kind(before: dict[str, Column], now: dict[str, Column]) -> Column:
    """What happened to the asset between two snapshots; null when nothing did."""
    same = lambda c: before[c].eqNullSafe(now[c])
    text = lambda s, c: F.coalesce(s[c], F.lit(""))
    changed = ~(same("asset_id") & same("path") & same("revision_id") & same("status"))
    moved = (text(before, "asset_id") != text(now, "asset_id")) | (text(before, "path") != text(now, "path"))
    preferred = F.nullif(F.trim(now["preferred_kind"]), F.lit("")) if "preferred_kind" in now else F.lit(None).cast("string")
    return F.when(changed, F.when(now["asset_id"].isNull(), "asset/cleared").when(preferred.isNotNull(), preferred).when(moved, "asset/opened").when(
        text(before, "revision_id") != text(now, "revision_id"), "asset/revision_changed").otherwise("asset/updated"))


def change_events(states: DataFrame, *, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Events between successive snapshots of a session, in the order asset, playhead, selection.

    Needs the state columns; the first snapshot is compared with an empty state.
    """
    rows = shift(states, key, order, {f"_p_{c}": (c, -1) for c in STATE})
    before, now = {c: F.col(f"_p_{c}") for c in STATE}, {c: F.col(c) for c in (*STATE, "preferred_kind") if c in rows.columns}
    event = lambda k, kind, payload: F.when(kind.isNotNull(), F.struct(F.lit(k).alias("pos"), kind.alias("kind"), payload.alias("payload")))
    differs = lambda c, kind: F.when(~before[c].eqNullSafe(now[c]), F.lit(kind))
    events = F.array_compact(F.array(
        event(0, _kind(before, now), F.concat_ws("|", F.coalesce("asset_id", F.lit("")), F.coalesce("revision_id", F.lit("")))),
        event(1, differs("playhead", KINDS[1]), F.col("playhead").cast("string")),
        event(2, differs("selection", KINDS[2]), F.col("selection").cast("string"))))
    return rows.select(key, order, F.explode(events).alias("_e"), *[c for c in rows.columns if c == "_run"]).select(
        key, order, "_e.pos", "_e.kind", "_e.payload", *[c for c in rows.columns if c == "_run"])


def numbered(events: DataFrame, *, key: str = "session_id", order: str = "seq", retained: int = RETAINED) -> DataFrame:
    """Event ids growing by one per session; only the last `retained` stay, as the log holds no more."""
    rows = row_index(events, key, [order, "pos"], "event_id")
    last = rows.groupBy(key).agg(F.max("event_id").alias("_last"))
    return plain(rows.join(last, key).filter(F.col("event_id") > F.col("_last") - retained).drop("_last"))


def poll(log: DataFrame, cursors: DataFrame, *, limit: int = POLL_LIMIT, key: str = "session_id") -> DataFrame:
    """Events after each session's cursor (session_id, after), at most `limit`, with a flag when the cursor is older
    than the log.
    """
    ends = log.groupBy(key).agg(F.min("event_id").alias("_oldest"), F.max("event_id").alias("latest_event_id"))
    at = cursors.join(ends, key, "left")
    at = at.withColumn("reset_required", F.coalesce((F.col("after") > 0) & (F.col("_oldest") > 0) & (F.col("after") < F.col("_oldest") - 1), F.lit(False)))
    rows = log.join(at, key).filter(F.col("event_id") > F.col("after"))
    start = F.greatest(F.col("after"), F.col("_oldest") - 1)
    # Ids have no holes, so the limit is a range of ids.
    return rows.filter(F.col("event_id") <= start + min(limit, POLL_LIMIT)).drop("_oldest", "after")


def revision_states(commands: DataFrame, *, key: str = "asset_id", order: str = "seq") -> DataFrame:
    """State of an asset's revision after each command (command, revision_id, message).

    Commands: dirty, clean, ready, set, failed. Every field is the value of the last command that touches it, so a
    running maximum of (position, value) replaces a fold.
    """
    c, rev = F.col("command"), F.nullif(F.col("revision_id"), F.lit(""))
    ready = c.isin("ready", "set")
    touch = lambda cond, value: F.when(cond, F.struct(F.col(order).alias("at"), value.alias("v")))
    named = (c == "dirty") & rev.isNotNull()
    rows = commands.withColumns({
        "_pend": touch(named | c.isin("clean", "failed") | ready, F.when(named, rev)),
        "_ready": touch(ready, rev),
        "_msg": touch(((c == "failed") & (F.coalesce("message", F.lit("")) != "")) | (c == "clean") | ready, F.when(c == "failed", F.col("message")))})
    rows = _running_last(rows, key, order, ("_pend", "_ready", "_msg"))
    rows = shift(rows, key, order, {"_before": ("_pend_now", -1)})
    rows = rows.withColumn("_fail", touch((c == "failed") & F.coalesce(rev, F.col("_before.v")).isNotNull(), F.coalesce(rev, F.col("_before.v"))))
    rows = _running_last(rows, key, order, ("_fail",))
    status = F.when(c == "dirty", "dirty").when(c == "failed", "failed").otherwise("clean")
    out = rows.select(key, order, status.alias("status"), (c.isin("dirty", "failed")).alias("is_dirty"), F.col("_pend_now.v").alias("pending_revision_id"),
                      F.col("_ready_now.v").alias("last_ready_revision_id"), F.col("_fail_now.v").alias("last_failed_revision_id"),
                      F.col("_msg_now.v").alias("failure_message"))
    return out


def _running_last(rows: DataFrame, key: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    """Latest non-null (position, value) struct so far of each column, as `<column>_now`."""
    return running(rows, key, order, {f"{c}_now": ("max", c) for c in columns})


def merged_transport(updates: DataFrame, *, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Playhead and selection after each update: each keeps its latest given value."""
    held = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v")))
    rows = updates.withColumns({"_pl": held("playhead"), "_se": held("selection")})
    rows = _running_last(rows, key, order, ("_pl", "_se"))
    return plain(rows.select(key, order, F.col("_pl_now.v").alias("playhead"), F.col("_se_now.v").alias("selection"),
                             *[c for c in rows.columns if c == "_run"]))


def ring_buffer(frames: DataFrame, depth: int, *, key: str = "recording", order: str = "frame") -> DataFrame:
    """The last `depth` frames of every recording."""
    rows = row_index(lay_out(frames, key, order), key, order, "_i")
    last = rows.groupBy(key).agg(F.max("_i").alias("_last"))
    return plain(rows.join(last, key).filter(F.col("_i") > F.col("_last") - depth).drop("_i", "_last"))


# Streams

EVENT_SCHEMA = "session_id string, seq long, pos int, kind string, payload string"


def _events_between(rows: Sequence[tuple], names: Sequence[str], idle_ms: int) -> Iterator[tuple]:
    """(seq, pos, kind, payload) of ordered snapshots after the first, each compared with the one before it, or with an empty
    state when that is longer ago than `idle_ms`. Plain tuples, as a session has few rows and a frame costs more than they do."""
    place = {c: i for i, c in enumerate(names)}
    seq, at, preferred = place["seq"], place["at_ms"], place.get("preferred_kind")
    asset, path, revision, status, playhead, selection = (place[c] for c in STATE)
    text = lambda row, i: "" if row[i] is None else str(row[i])
    nothing = (None,) * len(names)
    for k in range(1, len(rows)):
        before, now = rows[k - 1], rows[k]
        if now[at] - before[at] > idle_ms:
            before = nothing
        if any(now[i] != before[i] for i in (asset, path, revision, status)):
            wanted = "" if preferred is None else text(now, preferred).strip(" ")
            kind = ("asset/cleared" if now[asset] is None else wanted if wanted
                    else "asset/opened" if text(before, asset) != text(now, asset) or text(before, path) != text(now, path)
                    else "asset/revision_changed" if text(before, revision) != text(now, revision) else "asset/updated")
            yield now[seq], 0, kind, f"{text(now, asset)}|{text(now, revision)}"
        for pos, i in ((1, playhead), (2, selection)):
            if now[i] != before[i]:
                yield now[seq], pos, KINDS[pos], None if now[i] is None else str(now[i])


def _tuples(pdf: pd.DataFrame, snapshot: T.StructType) -> list[tuple]:
    """Rows of state; pandas turns whole numbers with gaps into floats, which go back here."""
    columns = []
    for f in snapshot.fields:
        whole = isinstance(f.dataType, T.IntegralType)
        columns.append([None if v is None or v != v else int(v) if whole else v for v in pdf[f.name].tolist()])
    return list(zip(*columns, strict=True))


#: Bundles of sessions that share a state; the rows waiting in one and its last snapshots are in a task's memory at once.
BUNDLES = 1_024


def _change_events(snapshot: T.StructType, idle_ms: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """Snapshots wait in the state until the watermark has passed them and are compared in order; a session that stays
    without one for `idle_ms` of event time loses its state. A bundle of sessions has one state and one timeout, the next that
    any of them needs, as a call costs more than the rows of a session.
    """
    names = snapshot.names
    seq, at = names.index("seq"), names.index("at_ms")

    def settle(session: str, old: tuple | None, rows: list[tuple], now: int) -> tuple[list[tuple], tuple | None, list[tuple]]:
        """A session's events up to the watermark, its last snapshot and the rows that still wait."""
        # a snapshot older than the last one compared has come too late
        due = sorted((r for r in rows if r[at] <= now and (old is None or r[seq] > old[seq])), key=lambda r: r[seq])
        found = []
        if due:
            nothing = tuple(due[0][at] if c == "at_ms" else None for c in names)
            found = [(session, *e) for e in _events_between([nothing if old is None else old, *due], names, idle_ms)]
        return found, due[-1] if due else old, [r for r in rows if r[at] > now]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        sessions: dict[str, tuple[tuple | None, list[tuple]]] = pickle.loads(state.get[0]) if state.exists else {}
        events: list[tuple] = []
        if state.hasTimedOut:
            for session in list(sessions):
                found, old, rest = settle(session, *sessions[session], now)
                events += found
                sessions[session] = (old, rest)
                if not rest and (old is None or old[at] + idle_ms <= now):
                    del sessions[session]
        else:
            for pdf in frames:
                pdf = pdf[pdf["session_id"].notna()]  # other rows only move the watermark
                pdf = pdf.assign(at_ms=pdf["at"].astype("datetime64[ms]").astype("int64"))
                for session, row in zip(pdf["session_id"].tolist(), _tuples(pdf, snapshot), strict=True):
                    sessions.setdefault(session, (None, []))[1].append(row)
        if events:
            who, seqs, places, kinds, payloads = zip(*events)
            yield pd.DataFrame({"session_id": who, "seq": np.array(seqs, np.int64), "pos": np.array(places, np.int32),
                                "kind": kinds, "payload": pd.Series(payloads, dtype=object)})
        if sessions:
            state.update((pickle.dumps(sessions),))
            state.setTimeoutTimestamp(max(now + 1, min(min(r[at] for r in rows) if rows else old[at] + idle_ms for old, rows in sessions.values())))
        elif state.exists:
            state.remove()

    return step


def change_event_stream(states: DataFrame, *, lateness: str = "0 seconds", idle_sec: float = 86_400.0, bundles: int = BUNDLES) -> DataFrame:
    """The change events as a stream; `at` is the snapshots' event time, `seq` their order.

    A snapshot is compared once the watermark (`lateness` behind the latest event time) has passed it, so snapshots may
    come out of order up to that; later ones are dropped. A session without a snapshot for `idle_sec` is forgotten: its
    next snapshot is compared with an empty state. Rows without a session only move the watermark.
    """
    types = [("seq", T.LongType()), ("at_ms", T.LongType()), *((c, states.schema[c].dataType) for c in (*STATE, "preferred_kind") if c in states.columns)]
    snapshot = T.StructType([T.StructField(c, t) for c, t in types])
    rows = states.withWatermark("at", lateness).withColumn("_bundle", F.pmod(F.xxhash64("session_id"), F.lit(bundles)).cast("int"))
    return rows.groupBy("_bundle").applyInPandasWithState(
        _change_events(snapshot, int(idle_sec * 1000)), EVENT_SCHEMA, "sessions binary", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into Parquet files; the checkpoint makes a restart continue exactly once."""
    spark = stream.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state on disk
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).outputMode("append").start()
    finally:
        spark.conf.set(store, before)
    query.awaitTermination()


def reanalyse_stream(onsets: DataFrame, apply_update, checkpoint: str) -> None:
    """Each micro-batch of new onset lists replaces the affected recordings through `apply_update(batch, epoch)`."""
    query = onsets.writeStream.foreachBatch(apply_update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
