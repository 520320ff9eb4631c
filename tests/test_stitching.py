import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom import api
from wordloom.config import AlignmentConfig, Vocabulary, preset, presets_by_family
from wordloom.functions import labels
from wordloom.functions.tokenizers import CharTokenizer
from wordloom.hooks import Registry, score_frames
from wordloom.operators import decoding, stitching
from wordloom.operators.stitching import diff_path, drop_isolated, edit_path, longest_increasing

TOKENS = "recording_id long, segment_index int, pos int, token_id long, frame long, score double, wid long, tk string"


def tokens(spark, segments):
    """segments: list of lists of (wid, frame)."""
    rows = [(1, s, p, w if w is not None else 99, f, 0.5, w, "x") for s, seg in enumerate(segments) for p, (w, f) in enumerate(seg)]
    return spark.createDataFrame(rows, TOKENS)


@pytest.mark.parametrize("values,n", [([1, 2, 3, 4, 5], 5), ([5, 4, 3, 2, 1], 1), ([1, 3, 2, 4, 5], 4), ([1, 5, 2, 6, 3, 7, 4, 8, 9, 10, 11, 15, 12, 16, 13], 10), ([1, 2, 2, 3, 3, 3, 4], 4), ([], 0), ([42], 1)])
def test_lis(values, n):
    got = [values[i] for i in longest_increasing(values)]
    assert len(got) == n and all(a < b for a, b in zip(got, got[1:], strict=False))


@given(st.lists(st.integers(0, 20), max_size=12))
def test_lis_is_longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    assert len(longest_increasing(values)) == max(best, default=0)


def test_outliers_as_windows(spark):
    cases = {1: [0, *range(100, 200)], 2: [*range(1, 50), 1000], 3: [1, 500, 900]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k int, v int")
    got = {k: sorted(r.v for r in rows) for k, rows in ((k, stitching.remove_outliers(df.where(F.col("k") == k), ["k"], "v", "v", 10, 60).collect()) for k in cases)}
    assert got[1][0] == 100 and got[2][-1] == 49 and got[3] == cases[3]
    for seed in range(6):
        rng = random.Random(seed)
        v = sorted(rng.sample(range(3000), rng.randint(5, 60)))
        df = spark.createDataFrame([(1, x) for x in v], "k int, v int")
        assert sorted(r.v for r in stitching.remove_outliers(df, ["k"], "v", "v", 10, 60).collect()) == stitching._cut_outliers(v, 10, 60)


def test_isolated():
    assert len(drop_isolated(list(range(100)))) >= 90 and drop_isolated([1, 2, 3, 4, 5]) == [1, 2, 3, 4, 5] and drop_isolated([]) == []
    assert 50 not in drop_isolated([*range(10), 50, *range(90, 100)])


@pytest.mark.parametrize("ids,threshold,holes", [
    ([0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 14, 19, 20], 0, [(5, 8), (15, 18)]), ([*range(10), *range(16, 30)], 3, [(10, 15)]), ([0, 1, 2, 5, 6, 7], 3, [(3, 4)]), ([3], 3, []), ([0, 2, 3, 5, 8], 3, [(1, 7)]),
])
def test_holes(spark, ids, threshold, holes):
    df = spark.createDataFrame([(1, i) for i in ids], "recording_id long, wid long")
    assert sorted((r.start_idx, r.end_idx) for r in stitching.find_holes(df, ["recording_id"], "wid", threshold).collect()) == holes


@pytest.mark.parametrize("pairs,threshold,want", [([(0, 5), (10, 15), (20, 25)], 2, 3), ([(0, 5), (8, 15)], 3, [(0, 15)]), ([(0, 10), (5, 15), (12, 20)], 0, [(0, 20)]), ([(1, 2), (4, 5)], 2, [(1, 5)])])
def test_merge(spark, pairs, threshold, want):
    df = spark.createDataFrame([(1, a, b) for a, b in pairs], "k int, start_idx long, end_idx long")
    got = sorted((r.start_idx, r.end_idx) for r in stitching.merge_holes(df, ["k"], threshold).collect())
    assert len(got) == want if isinstance(want, int) else got == want


def test_stitch(spark):
    t = tokens(spark, [[(0, 10), (1, 20), (None, 22), (2, 30)], [(1, 25), (2, 35), (None, 36), (3, 45), (4, 55)]])
    out, holes = stitching.stitch(t, "lis", filters=False)
    rows = out.orderBy("ord").collect()
    assert [r.wid for r in rows if r.wid is not None] == [0, 1, 2, 3, 4] and holes.count() == 0
    assert len(rows) == 6
    with pytest.raises(ValueError):
        stitching.stitch(t, "none")
    deduped, none = stitching.stitch(tokens(spark, [[(0, 10)], [(0, 10), (1, 20)]]), "levenshtein")
    assert none is None and sorted(r.frame for r in deduped.collect()) == [10, 20]


def test_edit_paths():
    assert edit_path(["hello", "world"], ["hello", "there"]) == (1.0, [("match", 0, 0), ("sub", 1, 1)])
    assert edit_path(["hello"], ["hello", "world"])[1][-1] == ("ins", None, 1) and edit_path(["hello", "world"], ["hello"])[1][-1] == ("del", 1, None)
    assert edit_path(["HELLO", "WORLD"], ["hello", "world"])[0] == 0 and edit_path(["hello", "world"], ["hello", "there"], 1, 1, 5)[0] == 2.0
    assert edit_path([], []) == (0.0, [])
    assert [s[0] for s in diff_path("the quick brwn fox".split(), "the quick brown fox jumps".split())[1]] == ["equal", "equal", "replace", "equal", "insert"]


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_edit_distance_is_levenshtein(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    total, steps = edit_path(a, b)
    assert total == d[-1][-1] == sum(s[0] != "match" for s in steps)


def test_transfer(spark):
    rows = [(1, 0, p, p, f, 1.0, p, w) for p, (w, f) in enumerate([("hello", 10), ("wrld", 50), ("test", 90)])]
    spoken = spark.createDataFrame(rows, TOKENS)
    reference = spark.createDataFrame([(1, i, w) for i, w in enumerate(["hello", "world", "test"])], "recording_id long, idx int, word string")
    for method in ("edit_distance", "diff"):
        out, holes = stitching.stitch(spoken, method, reference)
        got = out.orderBy("wid").collect()
        assert [(r.frame, r.score) for r in got] == [(10, 1.0), (50, 0.5), (90, 1.0)] and holes.count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "i int, x array<double>")
    got = df.select(labels.log_softmax(F.col("x")).alias("y"), labels.roll_blank(F.col("x")).alias("r"), labels.add_star(F.col("x")).alias("s")).first()
    assert sum(2.718281828459045**v for v in got.y) == pytest.approx(1) and got.r == [3.0, 1.0, 2.0] and got.s[-1] == -5.0
    frames = spark.createDataFrame([(1, i, [1.0 if k == j else 0.0 for j in range(3)]) for i, k in enumerate([0, 1, 1, 0, 1, 2])], "k int, frame int, logp array<double>")
    assert labels.greedy_text(frames, ["k"], ["-", "a", "b"]).first().text == "aab"
    ids = spark.createDataFrame([([1, 2, 1, 9],)], "x array<int>")
    assert ids.select(labels.decode_ids(F.col("x"), ["-", "a", "|"], "pipe").alias("y")).first().y == "a a"


#: True frames of an utterance, 50 frames a second.
TRUTH = [("I", 31, 35), ("HAD", 37, 44), ("THAT", 45, 53), ("CURIOSITY", 56, 92), ("BESIDE", 95, 116), ("ME", 118, 124), ("AT", 126, 129), ("THIS", 131, 139), ("MOMENT", 143, 157)]
CHARS = CharTokenizer(("-", *"abcdefghijklmnopqrstuvwxyz'", "*"))


def emissions(low, high):
    rows = []
    for t in range(low, high):
        label = 0
        for w, a, b in TRUTH:
            if a <= t < b:
                label = CHARS.ids[w[min(len(w) - 1, (t - a) * len(w) // (b - a))].lower()]
        rows.append([-0.05 if i == label else -6.0 for i in range(29)])
    return rows


def test_alignment_end_to_end(spark):
    transcripts = spark.createDataFrame([(1, " ".join(w for w, _, _ in TRUTH))], "recording_id long, text string")
    reference = api.prepare_transcripts(transcripts)
    parts = [(0, 0, emissions(0, 118)), (1, 94, emissions(94, 170))]
    frames = spark.createDataFrame([(1, s, t, x) for s, _, rows in parts for t, x in enumerate(rows)], "recording_id long, segment_index int, frame int, logp array<double>")
    segments = spark.createDataFrame([(1, s, o) for s, o, _ in parts], "recording_id long, segment_index int, frame_offset long")
    out = api.align(frames, reference, CHARS, segments, AlignmentConfig(drop_exits=True))
    got = out.words.orderBy("index").collect()
    assert [(r["index"], r.start_frame) for r in got] == [(i, a) for i, (_, a, _) in enumerate(TRUTH)]
    assert out.holes.count() == 0 and not any(r.rejected for r in out.segments.collect())


def test_graph_sizes(spark):
    words = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [])], "doc_id long, idx int, ids array<int>")
    t = decoding.token_table(words, unknown=28)
    assert [r.id for r in t.orderBy("c").collect()] == [1, 2, 28]
    arcs = decoding.factor_arcs(t).collect()
    assert sum(a.label == -1 for a in arcs) == 1 and sum(a.aux == 8 for a in arcs) == 2 and sum(a.aux == 7 for a in arcs) == 1
    assert decoding.ctc_arcs(t).where("label = -1").count() == 2


def test_registry_and_hooks(spark):
    r = Registry("model")

    @r.named("a", aliases=("b",))
    class A:
        labels = ["-"]

        def load(self):
            self.ready = True

        def predict(self, batch):
            return batch.assign(frame=0)

    r.register_lazy("late", lambda: A)
    r.register_lazy("missing", lambda: __import__("no_such_module_here"))
    assert "b" in r and r.available("late") and not r.available("missing") and list(r) == ["a", "late", "missing"]
    assert isinstance(r.get("b"), A)
    with pytest.raises(ValueError):
        r.get("zzz")
    assert score_frames(spark.range(2), A, "id long, frame int").count() == 2
    assert preset("conformer-ctc")["frame_duration"] == 0.04 and preset("my-conformer")["family"] == "conformer" and preset("other")["family"] == "transformer"
    assert presets_by_family(spark).count() == 3 and len(Vocabulary(("-", "a"))) == 2 and "a" in Vocabulary(("-", "a"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=10))
def test_continuation_keeps_order(spark, wids):
    t = stitching.with_order(tokens(spark, [[(w, 10 * i) for i, w in enumerate(wids)]]))
    out = stitching.continue_words(t, stitching.lis_words(t, filters=False))
    got = [r.wid for r in out.orderBy("ord").collect()]
    assert got == sorted(set(got))
