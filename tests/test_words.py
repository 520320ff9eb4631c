import json

import pytest
from pyspark.sql import functions as F

from wordloom.operators import words as wt
from wordloom.sources import exports, readers
from wordloom.schema import WORDS

SIX = [("hello", 100, 150), ("world", 160, 220), ("this", 230, 270), ("is", 280, 300), ("a", 310, 325), ("test", 330, 400)]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(1, i, w, a, b, 0.0, None) for i, (w, a, b) in enumerate(SIX)], WORDS)


def test_statistics(spark, six):
    totals = spark.createDataFrame([(1, 20, 10.0)], "recording_id long, total_words int, audio_duration double")
    holes = spark.createDataFrame([(1, 6, 8), (1, 15, 17)], "recording_id long, start_idx long, end_idx long")
    r = wt.statistics(six, totals=totals, holes=holes).first()
    assert (r.num_words, r.num_unaligned_regions, r.coverage_percent, r.gap_count, r.words_with_score) == (6, 2, 30.0, 5, 0)
    assert (r.start, r.end, r.duration_mean, r.duration_min, r.duration_max, r.duration_median, r.gap_total, r.gap_max) == pytest.approx((2.0, 8.0, 0.85, 0.3, 1.4, 1.0, 0.9, 0.2))
    assert r.confidence_mean is None and wt.statistics(six.limit(0)).count() == 0
    assert "6 words" in wt.summary(wt.statistics(six)).first().summary


def test_end_frames(six):
    got = [r.end_frame for r in wt.end_frames(six.drop("end_frame")).orderBy("index").collect()]
    assert got == [150, 210, 280, 310, 330, 380]


def test_lookups(spark, six):
    at = spark.createDataFrame([(1, 2.5), (1, 3.1), (1, 3.0)], "recording_id long, time double")
    assert {r.time: r.word for r in wt.words_at(at, six).collect()} == {2.5: "hello", 3.0: "hello"}
    assert [r.word for r in wt.words_in_range(six, 3.0, 5.0).orderBy("index").collect()] == ["world", "this"]
    assert wt.text(six).first().text == "hello world this is a test"
    assert [r.word for r in wt.first_words(six, 2).orderBy("index").collect()] == ["hello", "world"]
    assert [r.end_s for r in wt.sequential_clips(six, 0, 2).orderBy("position").collect()] == pytest.approx([3.2, 4.7])
    p = wt.preview(six, 1, 2, padding=0.1).first()
    assert (p.text, p.start_s, p.end_s, p.start_sample) == ("world this", pytest.approx(3.1), pytest.approx(5.5), 49600)
    assert wt.preview_random(six, 3, seed=1).count() == 3 and wt.preview_random(six, 30).count() == 6


def test_display(spark):
    df = spark.createDataFrame([(1, 0, "hello", 100, 150, 0.95, "Hello!"), (1, 1, "x", 150, 160, 0.1, None), (1, 2, "y", 150, 160, 0.1, "y")], WORDS)
    assert [r.display for r in wt.with_seconds(df).orderBy("index").collect()] == ["Hello! (hello)", "x", "y"]


def test_exports(six):
    lines = exports.lines_file(exports.label_lines(six)).first().text.split("\n")
    assert len(lines) == 6 and lines[0] == "2.000000\t3.000000\thello"
    assert exports.subtitle_cues(six).first().start == "00:00:02,000" and exports.subtitle_cues(six).first().end == "00:00:08,000"
    ctm = exports.lines_file(exports.ctm_lines(six)).first().text.split("\n")
    assert len(ctm) == 6 and ctm[0].split() == ["audio", "1", "2.000", "1.000", "hello"]
    j = json.loads(exports.json_file(six).first().text)
    assert j["words"][0] == {"word": "hello", "start": 2.0, "end": 3.0, "index": 0}
    assert exports.label_lines(six, frame_duration=0.01).orderBy("index").first().line.startswith("1.000000")
    assert exports.karaoke_lines(six).first().line.startswith("Dialogue: 0,0:00:02.00,0:00:08.00,Default,,0,0,0,,{\\kf120}hello")
    assert "[Events]" in exports.karaoke_file(six).first().text
    assert exports.textgrid_file(six.limit(0)).count() == 0


def test_page_and_clips(spark, six):
    transcript = spark.createDataFrame([(1, i, w) for i, (w, _, _) in enumerate(SIX)] + [(1, 6, "<end>")], "recording_id long, idx int, original string")
    page = exports.page_file(six, transcript).first().text
    assert page.count('class="word"') == 6 and "&lt;end&gt;" in page
    totals = spark.createDataFrame([(1, 8.02)], "recording_id long, duration double")
    rows = exports.clip_bounds(six.where("index <> 1"), totals).orderBy("index").collect()
    assert [r.word for r in rows][:2] == ["hello", "[1]"] and rows[1].start_s is None and rows[-1].end_s == 8.02


def test_grid_round_trip(spark, six):
    words, _ = readers.parse_textgrid(exports.textgrid_file(six).select(F.lit("a").alias("source"), "text"), frame_duration=0.02)
    assert [(r.word, r.start_frame, r.end_frame) for r in words.orderBy("index").collect()] == SIX
    grid = 'item [1]:\n name = "words"\n intervals [1]:\n xmin = 0\n xmax = 1\n text = "ab"\nitem [2]:\n name = "phones"\n intervals [1]:\n xmin = 0\n xmax = 0.5\n text = "a"\n intervals [2]:\n xmin = 1\n xmax = 2\n text = "c"'
    words, phones = readers.parse_textgrid(spark.createDataFrame([("s", grid)], "source string, text string"))
    assert words.first().end_frame == 100 and [(r.phone, r.word_index) for r in phones.collect()] == [("a", 0)]


def test_aligned_json(spark):
    doc = {"words": [{"word": "a", "case": "success", "start": 1.0, "end": 1.5, "phones": [{"phone": "x", "duration": 0.2}, {"phone": "y", "duration": 0.3}]}, {"word": "b", "case": "not-found-in-audio"}, {"word": "c", "case": "not-found-in-audio"}, {"word": "d", "case": "success", "start": 2.0, "end": 2.5, "phones": []}]}
    words, holes, phones = readers.parse_aligned_json(spark.createDataFrame([("s", json.dumps(doc))], "source string, text string"))
    assert [(r["index"], r.start_frame) for r in words.orderBy("index").collect()] == [(0, 100), (3, 200)]
    assert [(r.start_idx, r.end_idx) for r in holes.collect()] == [(1, 2)]
    assert [(r.phone, r.start_frame, r.end_frame) for r in phones.orderBy("pos").collect()] == [("x", 100, 120), ("y", 120, 150)]


def test_files(spark, six, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld", encoding="utf-8")
    assert readers.read_texts(spark, str(tmp_path / "a.txt")).first().text == "héllo\nworld"
    import numpy as np

    (tmp_path / "a.wav").write_bytes(readers.wav_bytes(np.array([0.0, 0.5, -0.5]), 8000))
    r = readers.read_wav(spark, str(tmp_path / "a.wav")).first()
    assert r.rate == 8000 and r.channels[0] == pytest.approx([0.0, 0.5, -0.5], abs=1e-3)
    exports.save(exports.subtitle_file(six), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("recording_id=1/*.txt"))


def test_accuracy(spark, six):
    r = wt.accuracy(six.withColumn("start_frame", F.col("start_frame") + 1), six).first()
    assert r.start_error_ms == pytest.approx(20.0) and 0.9 < r.mean_iou < 1
