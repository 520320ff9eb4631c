import math
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.operators import timeline
from wordloom.operators.stitching import longest_increasing
from wordloom.plans.helpers import asof_join, range_join
from wordloom.streaming import windows


def cuts(spark, pairs):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in pairs], "recording_id long, start double, end double")


def times(spark, values):
    return spark.createDataFrame([(1, float(t)) for t in values], "recording_id long, time double")


def test_segments(spark):
    df = spark.createDataFrame([(1, 80_000), (2, 960_000), (3, 3_000), (4, 0)], "recording_id long, n_samples long")
    rows = timeline.segment_windows(df).orderBy("recording_id", "segment_index").collect()
    by = {k: [(r.offset, r.length) for r in rows if r.recording_id == k] for k in (1, 2, 3, 4)}
    assert by[1] == [(0, 80_000)] and by[3] == [] and by[4] == []
    assert [o for o, _ in by[2]] == [0, 208_000, 416_000, 624_000, 832_000] and by[2][-1][1] == 128_000
    assert [r.f for r in timeline.segment_windows(df.where("recording_id = 2")).select(timeline.frame_offset(F.col("offset")).alias("f"), "segment_index").orderBy("segment_index").collect()] == [650 * k for k in range(5)]
    with pytest.raises(ValueError):
        timeline.segment_windows(df, size=1.0, overlap=2.0)


@pytest.mark.parametrize("pairs,to_original,to_new", [
    ([], {1: 1}, {1: 1}), ([(2, 4)], {1: 1, 2: 4}, {1: 1, 5: 3}), ([(0, 1), (3, 5), (6, 8)], {0: 1, 2: 5, 3: 8}, {}), ([(2, 4), (6, 8)], {}, {0: 0, 1: 1, 3: 2, 4.5: 2.5, 5: 3, 7: 4, 8.5: 4.5, 10: 6}),
])
def test_time_maps(spark, pairs, to_original, to_new):
    got = {r.time: r.original_time for r in timeline.map_to_original(times(spark, to_original), cuts(spark, pairs), ["recording_id"]).collect()}
    assert got == to_original
    got = {r.time: r.new_time for r in timeline.map_to_new(times(spark, to_new), cuts(spark, pairs), ["recording_id"]).collect()}
    assert got == pytest.approx(to_new)


def test_intervals(spark):
    rows = timeline.merge_intervals(cuts(spark, [(1, 3), (2, 5), (7, 8), (8, 9)]), ["recording_id"]).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(1, 5), (7, 9)]
    totals = spark.createDataFrame([(1, 10.0), (2, 4.0)], "recording_id long, total double")
    rows = timeline.flip_intervals(cuts(spark, [(0, 1), (3, 5)]), totals, ["recording_id"]).orderBy("recording_id", "start").collect()
    assert [(r.recording_id, r.start, r.end) for r in rows] == [(1, 1, 3), (1, 5, 10), (2, 0, 4)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)), max_size=6), st.lists(st.integers(0, 60), min_size=1, max_size=6, unique=True))
def test_maps_return_outside_silence(spark, raw, at):
    pairs = [(a, a + n) for a, n in raw]
    kept = [t for t in at if not any(a <= t < b for a, b in pairs)]
    if not kept:
        return
    there = timeline.map_to_new(times(spark, kept), cuts(spark, pairs), ["recording_id"])
    back = timeline.map_to_original(there, cuts(spark, pairs), ["recording_id"], "new_time", "back")
    assert all(math.isclose(r.time, r.back) for r in back.collect())


def test_silence(spark):
    frames = spark.createDataFrame([(1, i, 0.0 if 100 <= i < 200 else 1.0) for i in range(300)], "recording_id long, frame int, peak double")
    rows = timeline.silence_intervals(frames, ["recording_id"]).collect()
    assert [(round(r.start, 6), round(r.end, 6)) for r in rows] == [(1.1, 1.9)]
    totals = spark.createDataFrame([(1, 2.05)], "recording_id long, total double")
    rows = timeline.silence_intervals(frames.where("frame < 200"), ["recording_id"], totals=totals).collect()
    assert [(round(r.start, 6), round(r.end, 6)) for r in rows] == [(1.1, 1.95)]


def test_samples(spark):
    stereo = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 3.0)], "recording_id long, i int, channel int, value double")
    assert timeline.to_mono(stereo, ["recording_id", "i"]).first().value == 2.0
    loud = spark.createDataFrame([(1, 0.5), (1, -0.25), (2, 0.0)], "recording_id long, value double")
    out = timeline.normalize_peak(loud, ["recording_id"]).collect()
    assert max(abs(r.value) for r in out) == pytest.approx(10 ** (-3 / 20)) and [r.value for r in out if r.recording_id == 2] == [0.0]
    wave = spark.createDataFrame([(1, 8000, [math.sin(2 * math.pi * 440 * i / 8000) for i in range(800)]), (2, 16000, [0.0, 1.0])], "recording_id long, rate int, samples array<float>")
    got = {r.recording_id: r for r in timeline.resample(wave).collect()}
    assert len(got[1].samples) == 1600 and got[2].samples == [0.0, 1.0]
    assert all(abs(got[1].samples[i] - math.sin(2 * math.pi * 440 * i / 16000)) < 0.02 for i in range(200, 1400))
    arrays = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "c array<array<double>>").select(timeline.mono_arrays(F.col("c")).alias("m")).first().m
    assert arrays == [2.0, 4.0]
    peaks = timeline.frame_peaks(spark.createDataFrame([(1, [0.0] * 400 + [0.5] * 400)], "recording_id long, samples array<double>"), ["recording_id"])
    assert [r.peak for r in peaks.orderBy("frame").collect()] == [0.0, 0.5, 0.5]


def test_steps(spark):
    df = spark.range(3)
    assert timeline.enhance(df, ["a", "b"], {"a": lambda d: d.where("id > 0"), "b": lambda d: d.limit(1)}).count() == 1
    with pytest.raises(ValueError):
        timeline.enhance(df, ["x"], {})


def test_joins(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (2, 9.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 4.0, "b")], "k int, s double, v string")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "s", ["v"]).collect()}
    assert got == {(1, 5.0): "b", (1, 0.5): None, (2, 9.0): None}
    spans = spark.createDataFrame([(1, 0.0, 4.0, "x"), (1, 4.0, 20.0, "y")], "k int, a double, z double, v string")
    assert {r.t: r.v for r in range_join(left, spans, ["k"], "t", "a", "z", 2.0).collect()} == {5.0: "y", 0.5: "x"}


def drained(query, seconds=120):
    """Waits for a query that ends by itself, for so long at most."""
    try:
        assert query.awaitTermination(seconds), "the stream didn't end"
    finally:
        query.stop()


def test_stitching_stream(spark, tmp_path):
    rng = random.Random(4)
    told = [(k, i, rng.randrange(40), 10 * i) for k in (1, 2) for i in range(60)]
    for part in range(6):
        rows = [(k, i, w if i % 7 else None, f, k == 1 and i == 59, datetime(2024, 1, 1, 0, 0, i)) for k, i, w, f in told if i // 10 == part]
        spark.createDataFrame(rows, "recording_id long, ord int, wid long, frame long, last boolean, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    schema = "recording_id long, ord int, wid long, frame long, last boolean, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "t"))
    drained(windows.stitch_stream(stream).writeStream.format("memory").queryName("stitched").outputMode("append").trigger(availableNow=True).start())
    got = spark.table("stitched").collect()
    for k in (1, 2):
        rows = [(i, w, f) for r, i, w, f in told if r == k and i % 7]
        want = [rows[j][1:] for j in longest_increasing([w for _, w, _ in rows])]
        held = {}
        for r in got:
            if r.recording_id == k:
                held[r.pos] = (r.wid, r.frame)
        assert [held[p] for p in range(len(want))] == want
    assert [r.wid for r in got if r.recording_id == 1 and r.final] and not any(r.final for r in got if r.recording_id == 2)
    assert len(got) < 6 * 2 * 12


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 2.0), (1, "2024-01-01 00:00:14", 3.0)], "u int, t string, v double").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = windows.sliding_counts(stream, value="v").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    drained(q)
    want = {(r.start, r.n, r.total) for r in windows.sliding_counts(events, value="v").collect()}
    assert {(r.start, r.n, r.total) for r in spark.table("counts").collect()} == want
    assert windows.sessions(events, "u", gap="10 seconds").count() == 2
