"""Files, updates and streams."""

import functools
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tactus import layout as lo
from tactus.functions import text as tx
from tactus.operators import detectors as dt
from tactus.operators import matching as mt
from tactus.operators import profiles as pf
from tactus.operators import stats
from tactus.plans.catalog import QUERIES
from tactus.sources import readers as rd
from tactus.sources import updates as up
from tactus.sources import writers as wr
from tactus.streaming import sessions as ss


@pytest.fixture
def folder(tmp_path):
    return tmp_path / uuid.uuid4().hex


def test_onset_files(spark, folder):
    folder.mkdir()
    (folder / "a.csv").write_text('File Name,Onsets\nSong1.WAV,"0.100000, 0.500000"\n,"1"\nsong2.wav,"[1.4, 0.2; x]"\n')
    table = rd.read_table(spark, str(folder / "a.csv"))
    got = {(r.recording, r.onset_idx): r.t for r in rd.onset_table(table, "File Name", "Onsets").collect()}
    assert got == {("Song1.WAV", 0): 0.1, ("Song1.WAV", 1): 0.5, ("song2.wav", 0): 0.2, ("song2.wav", 1): 1.4}
    row = rd.lookup_row(table, "File Name", "Onsets", " song1.wav ", "File Name").first()
    assert row.onsets == [0.1, 0.5]
    with pytest.raises(ValueError):
        rd.lookup_row(table, "File Name", "Onsets", "none.wav", "File Name")
    with pytest.raises(ValueError):
        rd.lookup_row(table, "File Name", "Nope", "song1.wav", "File Name")
    (folder / "b.csv").write_text('File Name,Onsets\nSong1.WAV,"9"\n')
    both = rd.with_path(spark, str(folder / "*.csv"))
    assert rd.first_table_with(both, "File Name", "SONG1.wav", "Onsets").first().onsets == [0.1, 0.5]


def test_label_files_round_trip(spark, folder):
    onsets = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.25), ("b", 1, 3.0)], "recording string, onset_idx int, t double")
    wr.write_lines(wr.label_lines(onsets), str(folder), order=["onset_idx"])
    text = "".join(p.read_text() for p in sorted((folder / "recording=a").glob("part-*.txt")))
    assert text == "0.500000\t0.500000\tOnsetR_1\n1.250000\t1.250000\tOnsetR_2\n"
    (folder / "x.txt").write_text("oops\n0.75\t0.75\tk\n")
    assert [(r.recording, r.t) for r in rd.read_label_files(spark, str(folder / "x.txt")).collect()] == [("x", 0.75)]


def test_metadata_blocks(spark):
    doc = {"__general_metadata__": {"Species": "finch", "Group": " "}, "a.wav": {"metadata": {"Group": "x"}}, "b.wav": {"metadata": {}}, "c.wav": 3}
    per, general = rd.metadata_blocks(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert [tuple(r) for r in per.collect()] == [("a.wav", "Group", "x")]
    assert [tuple(r) for r in general.collect()] == [("Species", "finch")]


def test_text_grid(spark):
    words = spark.createDataFrame([("a", 1, 0.5, 1.0, "hi"), ("a", 2, 1.0, 1.5, "you")], "recording string, seq int, start double, end double, label string")
    points = spark.createDataFrame([("a", 1, 0.5)], "recording string, onset_idx int, t double")
    lines = wr.grid_lines(points, words, spark.createDataFrame([("a", 2.0)], "recording string, duration double"))
    text = [r.line for r in lines.orderBy("tier", "item", "part").collect()]
    assert text[0] == 'File type = "ooTextFile"' and "        intervals: size = 4" in text and text[-1] == '            text = ""'
    assert '            mark = "Onset_1"' in text and text[6] == "size = 2"


def test_upsert_touches_first_row_and_appends(spark):
    old = {"summaries": spark.createDataFrame([("A.wav", 1, "x"), ("a.WAV", 2, "y"), ("b.wav", 3, "z")], "recording string, n_onsets long, note string"),
           "dyads": spark.createDataFrame([("A.wav", 0.5), ("b.wav", 0.4)], "recording string, r_k double"), "other": spark.range(2)}
    new = {"summaries": spark.createDataFrame([("a.wav", 9, 1.5), ("c.wav", 8, 2.5)], "recording string, n_onsets long, npvi double"),
           "dyads": spark.createDataFrame([("a.wav", 0.1), ("c.wav", 0.2)], "recording string, r_k double")}
    out = wr.upsert(old, new, order="n_onsets")
    assert sorted(map(tuple, out["summaries"].collect()), key=str) == sorted([("A.wav", 9, "x"), ("a.WAV", 2, "y"), ("b.wav", 3, "z"), ("c.wav", 8, None)], key=str)
    assert sorted(map(tuple, out["dyads"].collect())) == [("a.wav", 0.1), ("b.wav", 0.4), ("c.wav", 0.2)]
    assert out["other"].count() == 2
    wide = wr.upsert(old, new, order="n_onsets", add_columns=True)["summaries"]
    assert {r.recording: r.npvi for r in wide.collect()} == {"A.wav": 1.5, "a.WAV": None, "b.wav": None, "c.wav": 2.5}


def test_patch_reports_and_refuses(spark):
    table = spark.createDataFrame([(1, "a.wav", "old"), (2, "A.WAV", "keep")], "id int, name string, onsets string")
    edits = spark.createDataFrame([(" a.wav", [0.5, 0.25], "Drums")], "recording string, onsets array<double>, layer string")
    patched, report = wr.patch_onsets(table, edits, name="name", onset_column="onsets", order="id")
    assert [tuple(r) for r in patched.orderBy("id").collect()] == [(1, "a.wav", "0.250000, 0.500000", "Drums"), (2, "A.WAV", "keep", None)]
    assert report.first().old_value == "old" and report.first().column_existed
    with pytest.raises(Exception, match="no row for"):
        wr.patch_onsets(table, edits.withColumn("recording", F.lit("z")), name="name", onset_column="onsets", order="id")[1].collect()


SNAPSHOTS = "session_id string, seq long, asset_id string, path string, revision_id string, status string, playhead long, selection string, preferred_kind string"


def streamed(spark, folder, files, **options):
    """Drains one file of snapshots after the other, each in a run of its own from the same checkpoint; `at` is `seq` in seconds."""
    for rows in files:
        spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(SNAPSHOTS).parquet(str(folder / "in")).withColumn("at", F.timestamp_seconds("seq"))
        ss.run_to_files(ss.change_event_stream(stream, **options), str(folder / "out"), str(folder / "chk"))
    return sorted(map(tuple, spark.read.parquet(str(folder / "out")).collect()), key=str)


def tick(seq):
    return (None, seq, *[None] * 7)


def test_session_stream_puts_snapshots_in_order_and_survives_restarts(spark, folder):
    states = [("s1", 1, "a", "p", "rev-1", "clean", 0, "w", None), ("s1", 2, "a", "p", "rev-2", "clean", 0, "w", " "), ("s1", 3, None, None, None, "clean", 5, "w", "mine"),
              ("s2", 1, "a", "p", "rev-1", "clean", 0, "v", "mine"), ("s1", 4, "b", "q", "rev-2", "dirty", 5, "v", "mine"), ("s2", 2, "a", "p", "rev-1", "dirty", None, "v", None)]
    want = sorted(map(tuple, ss.change_events(spark.createDataFrame(states, SNAPSHOTS)).select("session_id", "seq", "pos", "kind", "payload").collect()), key=str)
    files = [[states[2], states[3]], [states[0], states[5], states[4]], [states[1]], [tick(100_000)]]  # out of order over three batches
    got = streamed(spark, folder, files, lateness="10 seconds")
    assert got == want and ("s1", 3, 0, "asset/cleared", "|") in got and ("s1", 2, 0, "asset/revision_changed", "a|rev-2") in got
    assert ("s1", 4, 0, "mine", "b|rev-2") in got and ("s2", 1, 0, "mine", "a|rev-1") in got and ("s2", 2, 1, "transport/time_changed", None) in got


def test_late_snapshots_are_dropped_and_idle_sessions_forgotten(spark, folder):
    one = lambda seq, path: ("s1", seq, "a", path, "rev-1", "clean", 0, "w", None)
    files = [[one(10, "p")], [tick(100)], [one(20, "late")], [one(150, "p")], [tick(400)], [one(1_500, "p")], [tick(9_000)]]
    got = streamed(spark, folder, files, lateness="5 seconds", idle_sec=1_000.0)
    seqs = sorted({r[1] for r in got})
    assert seqs == [10, 1_500]  # 20 came after its time, 150 changed nothing, 1500 finds no state any more
    assert [r[3] for r in got if r[1] == 1_500 and r[2] == 0] == ["asset/opened"]


def test_bootstrap_is_the_same_at_every_partitioning_and_layout(spark, monkeypatch):
    rows = spark.range(400).select(F.lit("g").alias("grp"), (F.col("id") % 17).cast("double").alias("v"))
    a = stats.bootstrap_mean(rows.repartition(3), "v", 300, 1).first()
    b = stats.bootstrap_mean(rows.repartition(7), "v", 300, 1).first()
    monkeypatch.setattr(lo, "HOT_ROWS", 50)
    split = functools.partial(lo.lay_out, hot_rows=50, run_rows=20)
    monkeypatch.setattr(stats, "lay_out", split)
    c = stats.bootstrap_mean(rows, "v", 300, 1).first()
    assert a == b and a.ci_low == pytest.approx(c.ci_low, abs=1e-9) and a.ci_high == pytest.approx(c.ci_high, abs=1e-9)
    assert 7 < a.ci_low < 7.9 < a.ci_high < 9


def test_windows_are_tested_before_the_nearest_frame(spark):
    onsets = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 5.0)], "recording string, event_id long, t double")
    frames = spark.createDataFrame([("r", 0, 0.5, 0, 0.0, 1.0), ("r", 1, 1.2, 1, 1.15, 1.4)],
                                   "recording string, frame long, t double, window_index long, w_start double, w_end double")
    got = mt.into_windows(onsets, frames, 0.01).select("event_id", "frame", "window_index").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0)]


def test_metadata_prefers_the_stem_as_a_name(spark):
    sheet = spark.createDataFrame([(1, "a.mp3", "x"), (2, "a", "y"), (3, "b.mp3", "z"), (4, "b.ogg", "w")], "row long, recording string, grp string")
    names = spark.createDataFrame([("a.wav",), ("b.wav",), ("c.wav",)], "recording string")
    got = rd.import_metadata(sheet, names, ["grp"], order="row").collect()
    assert {r.recording: r.grp for r in got} == {"a.wav": "y", "b.wav": "z", "c.wav": "NA"}


def test_canonical_json(spark):
    rows = [('{"a": 1, "n": {"x": [1, {"p": 2, "q": 3}], "y": 0}}', '{"n":{"y":0,"x":[1,{"q":3,"p":2}]},"a":1}', True),
            ('{"a":1}', '{"a":"1"}', False), ('[1,2]', '[2,1]', False), ('{"a":null}', '{}', False)]
    df = spark.createDataFrame(rows, "one string, two string, same boolean")
    got = df.select("same", (tx.canonical_json(F.col("one")) == tx.canonical_json(F.col("two"))).alias("found")).collect()
    assert all(r.same == r.found for r in got)


def test_suggested_detectors_are_registered(spark):
    values = [(a, b, c, d) for a in (0.1, 0.9) for b in (0.1, 0.9) for c in ("harmonic", "percussive") for d in ("harmonic", "percussive", None)]
    rows = spark.createDataFrame(values, "pos_harmonicity double, pos_sharpness double, pos_character string, neg_character string")
    assert {r.method for r in pf.method_choice(rows).collect()} <= set(dt.DETECTORS)


def test_streams_read_folder_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("e1_change_events_streamed", "e7_incremental_reanalysis"):
        one, many = (sorted(map(str, QUERIES[name](spark, sf).collect())) for sf in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one == many


@pytest.mark.parametrize("name", ["g2_resampled_null_distance", "g17_discriminant_resubstitution", "g17_discriminant_leave_one_out", "g19_confusion_matrix"])
def test_no_cartesian_plan(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def files_of(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_an_update_writes_only_its_bucket(spark, folder):
    pairs = [(f"Rec{i}.wav", k, i + k / 10) for i in range(30) for k in range(3)]
    tables = {"summaries": spark.createDataFrame([(f"Rec{i}.wav", i, "old") for i in range(30)], "recording string, n long, note string"),
              "dyads": spark.createDataFrame(pairs, "recording string, idx long, v double")}
    held = up.create(tables, str(folder), buckets=8)
    before = files_of(folder)
    fresh = {"summaries": spark.createDataFrame([("/x/REC3.WAV", 77, 5.0)], "recording string, n long, extra double"),
             "dyads": spark.createDataFrame([("/x/REC3.WAV", 0, -1.0)], "recording string, idx long, v double")}
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for add_columns in (False, True):
        new = up.update(held, fresh, add_columns=add_columns)
        after = files_of(folder)
        data = {f for f in after - before if not f.startswith("versions")}
        assert before <= after and len({f.split("_bucket=")[1].split("/")[0] for f in data}) == 1
        want = wr.upsert(tables, fresh, add_columns=add_columns)
        for name in ("summaries", "dyads"):
            assert rows(up.read(new, name)) == rows(want[name])
            assert rows(up.read(held, name)) == rows(tables[name])  # the version before is as it was
        before, held_after = after, new
        held = up.opened(spark, str(folder), 0, 8) if not add_columns else held
        if not add_columns:
            for f in [*(folder / "versions" / "1").iterdir()]:
                f.unlink()
            (folder / "versions" / "1").rmdir()
            before = files_of(folder)
    for i in range(3):  # more updates of one bucket, then only that one is compacted
        held_after = up.update(held_after, {**fresh, "summaries": spark.createDataFrame([("REC3.wav", i, None)], "recording string, n long, note string")})
    want = rows(up.read(held_after, "summaries"))
    before = files_of(folder)
    small = up.compact(held_after, deltas=3)
    data = {f for f in files_of(folder) - before if not f.startswith("versions")}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in data}) == 1
    assert rows(up.read(small, "summaries")) == want and small.manifest().filter("NOT base").isEmpty()
    assert len(up.read(small, "dyads").filter("lower(recording) LIKE '%rec3.wav'").collect()) == 1
    assert up.compact(small).version == small.version
