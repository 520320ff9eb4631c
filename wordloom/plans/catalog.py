"""The registered queries: every operator applied to whole tables, with its SQL where SQL has words for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import labels, numbers, scripts, text
from ..functions.tokenizers import CharTokenizer, encode_flat
from ..operators import decoding, stitching, timeline
from ..operators import words as wt
from ..sources import exports
from ..streaming import windows
from .helpers import asof_join, range_join

#: Seconds a frame where events are words: their gaps are hours.
FRAME = 1000.0
LABELS = ("-", *"abcdefghijklmnopqrstuvwxyz'", "*")
TOKENIZER = CharTokenizer(LABELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970; local times count as the session's, which is UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


# Mappings of the tables to words, tokens, intervals and emissions.


def event_words(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("index"), F.col("event_type").alias("word"),
        F.floor(micros("ts") / F.lit(1e9)).cast("long").alias("start_frame"), F.col("value").alias("score"),
        F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).alias("original"),
    )


def timed_words(spark: SparkSession, d: str) -> DataFrame:
    return wt.end_frames(event_words(spark, d))


def item_tokens(spark: SparkSession, d: str, modulo: int | None = 128) -> DataFrame:
    wid = F.col("l_partkey") if modulo is None else F.col("l_partkey") % modulo
    w = Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"), F.col("l_orderkey").alias("segment_index"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_partkey").alias("token_id"),
        (F.col("l_orderkey") % 50 * 10 + F.col("l_linenumber")).cast("long").alias("frame"), (-F.col("l_discount")).alias("score"),
        F.when(F.col("l_linenumber") % 4 != 0, wid).alias("wid"), F.col("l_returnflag").alias("tk"),
    )


def order_intervals(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(micros("o_orderdate") / F.lit(86_400_000_000)) % 2500
    return table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), start.cast("double").alias("start"), (start + 1 + F.col("o_orderkey") % 60).cast("double").alias("end"))


def order_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey"), (F.col("o_orderkey") % 2500).cast("double").alias("time"))


def vector_frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.col("vec_id").alias("frame"), F.slice("embedding", 1, 4).alias("logp"), "embedding")


def benchmark_tokens(spark: SparkSession, d: str) -> DataFrame:
    ws = text.word_table(table(spark, d, "benchmark"), "item_id")
    return decoding.token_table(ws.select("doc_id", "idx", TOKENIZER.encode_word(F.col("normalized")).alias("ids")))


def spoken_turns(spark: SparkSession, d: str) -> DataFrame:
    """All user words and all assistant words of each conversation, in turn order."""
    turns = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    said = lambda role: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"]), " ")
    return turns.groupBy(F.col("conv_id").alias("recording_id")).agg(text.words(said("user")).alias("a_words"), text.words(said("assistant")).alias("b_words"))


# Queries.


def normalize_basic(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_basic(F.col("text")).alias("text"))


def mms_words(spark, d):
    return text.word_table(table(spark, d, "documents"))


def mms_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_mms(F.col("text")).alias("text"))


def unknown_rate_by_lang(spark, d):
    ws = text.normalize_mms_words(text.words(F.col("text")))
    s = table(spark, d, "documents").select("lang", ws.alias("ws"))
    n, unknown = F.sum(F.size("ws")), F.sum(F.size(F.filter("ws", lambda w: w == "*")))
    return s.groupBy("lang").agg(n.alias("n_words"), unknown.alias("n_unknown"), F.round(unknown / n, 9).alias("rate"))


def word_count_invariant(spark, d):
    ws = text.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(ws).alias("n_original"), F.size(text.words(F.array_join(text.normalize_mms_words(ws), " "))).alias("n_normalized"))


def number_classes(spark, d):
    s = table(spark, d, "documents").select("lang", F.explode(text.words(F.col("text"))).alias("word"))
    return s.withColumn("class", numbers.number_class(F.col("word"))).groupBy("lang", "class").agg(F.count("*").alias("n"))


def expand_numbers(spark, d):
    s = table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).where(F.col("word").rlike("[0-9]")).distinct()
    return s.select("word", numbers.expand_number(F.col("word")).alias("spelled"))


def expanded_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(numbers.expand_numbers(text.words(F.col("text"))), " ").alias("text"))


def split_characters(spark, d):
    return table(spark, d, "benchmark").select("item_id", scripts.split_characters(F.col("text")).alias("text"))


def romanize_aligned(spark, d):
    ws = text.words(F.col("text"))
    half = F.filter(ws, lambda w, i: i % 2 == 0)
    out = table(spark, d, "documents").select("doc_id", F.size(ws).alias("n"), scripts.align_romanized(ws, half).alias("spread"), scripts.align_romanized(half, ws).alias("fused"))
    return out.select("doc_id", "n", F.array_join("spread", " ").alias("spread"), F.array_join("fused", " ").alias("fused"))


def char_encode(spark, d):
    s = table(spark, d, "documents").select("doc_id", TOKENIZER.encode(F.array_join(text.normalize_mms_words(text.words(F.col("text"))), " ")).alias("ids"))
    flat = encode_flat(F.col("ids"))
    return s.select("doc_id", F.size("ids").alias("n_words"), F.size(flat).alias("n_ids"), F.aggregate(flat, F.lit(0).cast("long"), lambda acc, x: (acc * 31 + x) % 1_000_000_007).alias("code"))


def char_roundtrip(spark, d):
    ws = text.word_table(table(spark, d, "benchmark"), "item_id")
    return ws.select(F.col("doc_id").alias("item_id"), "idx", "normalized", TOKENIZER.decode_word(TOKENIZER.encode_word(F.col("normalized"))).alias("decoded"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def source_kinds(spark, d):
    return table(spark, d, "pages").select("page_id", text.source_kind(F.col("url")).alias("kind"), text.keep_extracted(F.col("html")).alias("keep"))


def recover_original(spark, d):
    ws = text.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.recover_original(ws, F.array(F.lit(0), F.lit(3), F.lit(5), F.size(ws), F.lit(-1))), " ").alias("words"))


def segment_windows(spark, d):
    s = timeline.segment_windows(table(spark, d, "documents").select("doc_id", (F.length("text") * 400).cast("long").alias("n_samples")))
    return s.withColumn("frame_offset", timeline.frame_offset(F.col("offset")))


def sliding_counts(spark, d):
    out = windows.sliding_counts(table(spark, d, "events"), size="15 hours", step="13 hours", by=("event_type",), value="value")
    return out.select(micros("start").alias("start_us"), micros("end").alias("end_us"), "event_type", "n", F.round("total", 6).alias("total"))


def event_sessions(spark, d):
    out = windows.sessions(table(spark, d, "events"), "user_id", gap="36 hours")
    return out.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")


def silent_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("frame"), "value")
    return timeline.silent_runs(frames, ["user_id"], "frame", F.col("value") < 10)


def silence_cuts(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), (F.row_number().over(w) - 1).alias("frame"), (F.col("value") / 1000).alias("peak"))
    return timeline.silence_intervals(frames, ["recording_id"], hop=0.25, threshold_db=-36.0).select("recording_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def merge_intervals(spark, d):
    return timeline.merge_intervals(order_intervals(spark, d), ["recording_id"])


def flip_intervals(spark, d):
    s = order_intervals(spark, d)
    return timeline.flip_intervals(s, s.select("recording_id").distinct().withColumn("total", F.lit(2600.0)), ["recording_id"])


def time_map(spark, d):
    return timeline.time_map(order_intervals(spark, d), ["recording_id"])


def map_to_original(spark, d):
    return timeline.map_to_original(order_times(spark, d), order_intervals(spark, d), ["recording_id"])


def map_to_new(spark, d):
    return timeline.map_to_new(order_times(spark, d), order_intervals(spark, d), ["recording_id"])


def round_trip_times(spark, d):
    cuts = order_intervals(spark, d)
    new = timeline.map_to_new(order_times(spark, d), cuts, ["recording_id"]).select("recording_id", "o_orderkey", "time", F.col("new_time").alias("there"))
    back = timeline.map_to_original(new, cuts, ["recording_id"], "there", "back")
    return timeline.cut_intervals(back, cuts, ["recording_id"]).select("recording_id", "o_orderkey", "time", "back")


def asof_events(spark, d):
    """The last event of type ``click`` at or before each other event of its user."""
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("us"), "event_type")
    return asof_join(e.where("event_type <> 'click'").drop("event_type"), e.where("event_type = 'click'").select("user_id", F.col("us").alias("click_us"), F.col("event_id").alias("click_id")), ["user_id"], "us", "click_us", ["click_us", "click_id"])


def normalize_peak(spark, d):
    return timeline.normalize_peak(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"]).withColumn("value", F.round("value", 6))


def to_mono(spark, d):
    s = timeline.to_mono(table(spark, d, "events").select("user_id", F.floor(micros("ts") / F.lit(86_400_000_000)).alias("day"), "value"), ["user_id", "day"])
    return s.withColumn("value", F.round("value", 6))


def word_end_frames(spark, d):
    return timed_words(spark, d).select("recording_id", "index", "word", "start_frame", "end_frame")


def word_gaps(spark, d):
    return wt.gaps(timed_words(spark, d)).select("recording_id", "index", "gap")


def word_statistics(spark, d):
    s = wt.statistics(timed_words(spark, d), frame_duration=FRAME)
    return s.select("recording_id", "num_words", "start", "end", *[F.round(c, 6).alias(c) for c in ("duration_mean", "duration_min", "duration_max", "duration_median", "confidence_mean", "confidence_min", "confidence_max")], "words_with_score", "gap_count", *[F.round(c, 6).alias(c) for c in ("gap_total", "gap_mean", "gap_max")])


def word_coverage(spark, d):
    ws = timed_words(spark, d).where("index % 3 <> 1")
    totals = event_words(spark, d).groupBy("recording_id").agg(F.count("*").alias("total_words"), (F.max("start_frame") * FRAME).alias("audio_duration"))
    holes = stitching.find_holes(ws, ["recording_id"], "index", 0)
    s = wt.statistics(ws, frame_duration=FRAME, totals=totals, holes=holes)
    return s.select("recording_id", "num_words", "total_words", F.round("coverage_percent", 6).alias("coverage_percent"), "num_unaligned_regions")


def word_seconds(spark, d):
    return wt.with_seconds(timed_words(spark, d), FRAME).select("recording_id", "index", "start_s", "end_s", "duration_s", "duration_frames", "confidence", "display")


def words_at_time(spark, d):
    w = timed_words(spark, d)
    times = w.select("recording_id", ((F.col("start_frame") + F.col("index") % 40) * FRAME).alias("time")).distinct()
    return wt.words_at(times, w, frame_duration=FRAME, bucket=20 * FRAME)


def words_in_range(spark, d):
    return wt.words_in_range(timed_words(spark, d), 1.705e9, 1.71e9, FRAME).select("recording_id", "index", "word")


def words_by_index(spark, d):
    s = event_words(spark, d).withColumn("index", F.col("index") % 7 - 1).withColumn("order_", F.struct("start_frame", "score"))
    return wt.by_index(s, order="order_").select("recording_id", "index", "word", "start_frame", "score")


def timeline_text(spark, d):
    return wt.text(timed_words(spark, d), frame_duration=FRAME)


def label_lines(spark, d):
    return exports.label_lines(timed_words(spark, d), frame_duration=FRAME)


def ctm_lines(spark, d):
    return exports.ctm_lines(timed_words(spark, d), frame_duration=FRAME, name=F.col("recording_id").cast("string"))


def subtitle_cues(spark, d):
    return exports.subtitle_cues(timed_words(spark, d).withColumn("start_frame", F.col("start_frame") % 300_000).withColumn("end_frame", F.col("end_frame") % 300_000), frame_duration=0.25)


def karaoke_lines(spark, d):
    return exports.karaoke_lines(timed_words(spark, d).withColumn("start_frame", F.col("start_frame") % 300_000).withColumn("end_frame", F.col("end_frame") % 300_000), frame_duration=0.25)


def textgrid_intervals(spark, d):
    return exports.textgrid_intervals(timed_words(spark, d), frame_duration=FRAME)


def json_words(spark, d):
    j = exports.json_words(timed_words(spark, d).withColumn("score", F.col("score") - 20), frame_duration=0.25)
    g = lambda k, t: F.get_json_object("json", f"$.{k}").cast(t).alias(k)
    return j.select("recording_id", F.col("index").alias("i"), g("word", "string"), g("start", "double"), g("end", "double"), g("original", "string"), g("score", "double"), g("index", "long"))


def export_files(spark, d):
    """Whole files of every kind, by their length and digest."""
    w = timed_words(spark, d)
    files = {"label": exports.lines_file(exports.label_lines(w, frame_duration=FRAME)), "ctm": exports.lines_file(exports.ctm_lines(w, frame_duration=FRAME)), "srt": exports.subtitle_file(w, frame_duration=0.25), "textgrid": exports.textgrid_file(w, frame_duration=FRAME), "ass": exports.karaoke_file(w, frame_duration=0.25), "json": exports.json_file(w, frame_duration=FRAME)}
    out = None
    for kind, df in files.items():
        part = df.select("recording_id", F.lit(kind).alias("kind"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def page_words(spark, d):
    transcript = event_words(spark, d).select("recording_id", F.col("index").alias("idx"), F.coalesce("original", "word").alias("original"))
    return exports.page_words(timed_words(spark, d).where("index % 3 <> 1"), transcript, low=1, high=200, frame_duration=FRAME)


def clip_bounds(spark, d):
    w = timed_words(spark, d).where("index % 4 <> 2")
    totals = w.groupBy("recording_id").agg((F.max("end_frame") * FRAME - 500).alias("duration"))
    return exports.clip_bounds(w, totals, padding=900.0, frame_duration=FRAME)


def preview_segment(spark, d):
    return wt.preview(timed_words(spark, d), 5, 20, rate=16, frame_duration=FRAME, padding=100.0)


def preview_random(spark, d):
    return wt.preview_random(timed_words(spark, d), 10, seed=3).select("recording_id", "index", "word")


def sequential_clips(spark, d):
    return wt.sequential_clips(timed_words(spark, d), 2, 12, frame_duration=FRAME)


def first_words(spark, d):
    return wt.first_words(timed_words(spark, d), 50).select("recording_id", "index", "word")


def iou_metrics(spark, d):
    w = timed_words(spark, d)
    moved = w.withColumn("start_frame", F.col("start_frame") + F.col("index") % 7).withColumn("end_frame", F.col("end_frame") + F.col("index") % 5)
    s = wt.accuracy(moved, w, frame_duration=0.02)
    return s.select("recording_id", F.round("start_error_ms", 6).alias("start_error_ms"), F.round("mean_iou", 6).alias("mean_iou"), "n")


def flatten_tokens(spark, d):
    t = item_tokens(spark, d)
    nested = t.groupBy("recording_id", "segment_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id", "frame"))), lambda x: F.struct(x["token_id"].alias("token_id"), x["frame"].alias("frame"))).alias("tokens"), F.expr("segment_index % 5 = 0").alias("rejected"))
    return stitching.flatten_tokens(nested)


def dedupe_by_position(spark, d):
    return stitching.dedupe_by_position(item_tokens(spark, d)).select("recording_id", "frame", "segment_index", "pos", "token_id")


def lis_length(spark, d):
    s = stitching.lis_words(stitching.with_order(item_tokens(spark, d)), filters=False)
    return s.groupBy("recording_id").agg(F.count("*").alias("length"))


def lis_words(spark, d):
    return stitching.lis_words(stitching.with_order(item_tokens(spark, d)))


def stitched_tokens(spark, d):
    return stitching.stitch_lis(item_tokens(spark, d))[0].select("recording_id", "ord", "segment_index", "pos", "token_id", "wid")


def stitched_holes(spark, d):
    return stitching.stitch_lis(item_tokens(spark, d))[1]


def remove_outliers(spark, d):
    ids = item_tokens(spark, d, None).where("wid is not null").select("recording_id", "wid").distinct()
    return stitching.remove_outliers(ids, ["recording_id"], "wid", "wid", 100, 60)


def remove_isolated(spark, d):
    return stitching.remove_isolated(item_tokens(spark, d).where("wid is not null").select("recording_id", "wid").distinct(), ["recording_id"], "wid")


def unaligned_holes(spark, d):
    return stitching.find_holes(item_tokens(spark, d, None).where("wid is not null"), ["recording_id"], "wid")


def merge_holes(spark, d):
    s = order_intervals(spark, d).select("recording_id", F.col("start").cast("long").alias("start_idx"), F.col("end").cast("long").alias("end_idx"))
    return stitching.merge_holes(s, ["recording_id"], 20)


def edit_distance(spark, d):
    s = stitching.edit_alignment(spoken_turns(spark, d))
    return s.groupBy("recording_id").agg(F.max("total").alias("distance"))


def edit_steps(spark, d):
    return stitching.edit_alignment(spoken_turns(spark, d)).select("recording_id", "step", "op", "a_idx", "b_idx")


def diff_steps(spark, d):
    return stitching.diff_alignment(spoken_turns(spark, d)).select("recording_id", "step", "op", "a_idx", "b_idx")


def diff_statistics(spark, d):
    return stitching.diff_statistics(stitching.diff_alignment(spoken_turns(spark, d)))


def transfer_timestamps(spark, d):
    turns = spoken_turns(spark, d)
    spoken = turns.select("recording_id", F.posexplode("a_words").alias("idx", "w")).select("recording_id", "idx", F.lit(0).alias("token_id"), (F.col("idx") * 10).cast("long").alias("frame"), F.lit(0.8).alias("score"))
    reference = turns.select("recording_id", F.posexplode("b_words").alias("idx", "word"))
    return stitching.transfer_timestamps(stitching.edit_alignment(turns), spoken, reference)[0].drop("token_id")


def log_softmax(spark, d):
    s = vector_frames(spark, d).select("frame", F.posexplode(labels.log_softmax(F.col("embedding"))).alias("i", "v"))
    return s.select(F.col("frame").alias("vec_id"), "i", F.round("v", 5).alias("v"))


def greedy_labels(spark, d):
    return labels.greedy_labels(vector_frames(spark, d), ["label"]).toDF("recording", "pos", "frame", "token")


def greedy_text(spark, d):
    return labels.greedy_text(vector_frames(spark, d), ["label"], ["-", "a", "b", "c"])


def star_and_roll(spark, d):
    s = vector_frames(spark, d).select("frame", labels.add_star(labels.roll_blank(F.transform("logp", lambda v: v.cast("double")))).alias("x"))
    return s.select(F.col("frame").alias("vec_id"), F.size("x").alias("n"), F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.get("x", F.lit(1)), 6).alias("second"), F.element_at("x", -1).alias("star"))


def factor_arcs(spark, d):
    return decoding.factor_arcs(benchmark_tokens(spark, d))


def ctc_arcs(spark, d):
    return decoding.ctc_arcs(benchmark_tokens(spark, d))


def vocabulary(spark, d):
    chars = text.word_table(table(spark, d, "documents")).select(F.explode(F.split("normalized", "")).alias("label")).where("label <> ''").groupBy("label").agg(F.count("*").alias("n"))
    return chars.join(F.broadcast(config.Vocabulary(LABELS).table(spark)), "label").select("id", "label", "n")


def _spoken_frames(tokens: DataFrame) -> DataFrame:
    """Clear scores for every token in order: two frames of its label, then one of blank."""
    width = len(LABELS)
    score = lambda label: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == label, F.lit(-0.05)).otherwise(F.lit(-6.0)))
    rows = tokens.select("doc_id", F.explode(F.array(F.struct((F.col("c") * 3).alias("frame"), F.col("id").alias("x")), F.struct((F.col("c") * 3 + 1).alias("frame"), F.col("id").alias("x")), F.struct((F.col("c") * 3 + 2).alias("frame"), F.lit(0).alias("x")))).alias("f"))
    return rows.select("doc_id", "f.frame", score(F.col("f.x")).alias("logp"))


def viterbi_words(spark, d):
    """Word starts found in clear scores of every benchmark item: they are the true ones."""
    tokens = benchmark_tokens(spark, d)
    frames = _spoken_frames(tokens)
    stacked = frames.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "logp"))), lambda e: e["logp"]).alias("logp")).withColumn("segment_index", F.lit(0))
    paths = decoding.decode_segments(stacked, decoding.graph_arrays(decoding.factor_arcs(tokens)))
    sizes = tokens.groupBy("doc_id").agg(F.max("n").alias("n"))
    found = decoding.attach_symbols(decoding.path_tokens(paths, sizes), decoding.symbols(tokens))
    return found.where("wid is not null and not is_exit").select("doc_id", "wid", F.col("frame").cast("long").alias("frame"))


def segment_decisions(spark, d):
    tokens = benchmark_tokens(spark, d)
    frames = _spoken_frames(tokens).withColumn("segment_index", F.floor(F.col("frame") / 120).cast("int"))
    stacked = frames.groupBy("doc_id", "segment_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "logp"))), lambda e: e["logp"]).alias("logp"))
    paths = decoding.decode_segments(stacked, decoding.graph_arrays(decoding.factor_arcs(tokens)))
    out = decoding.segment_decisions(paths, tokens.groupBy("doc_id").agg(F.max("n").alias("n")))
    return out.select("doc_id", "segment_index", F.round("frame_score", 6).alias("frame_score"), F.round("skip_share", 6).alias("skip_share"), "n_returns", "rejected")


def align_items(spark, d):
    """The whole way: windows of clear scores, decoded, stitched and built into words."""
    from .. import api

    reference = api.prepare_transcripts(table(spark, d, "benchmark").select(F.col("item_id").alias("recording_id"), "text"))
    tokens = decoding.token_table(reference.select(F.col("recording_id").alias("doc_id"), "idx", TOKENIZER.encode_word(F.col("normalized")).alias("ids")))
    frames = _spoken_frames(tokens).withColumnRenamed("doc_id", "recording_id")
    span, lap = 300, 60
    last = F.floor(F.col("frame") / (span - lap)).cast("int")
    cut = frames.withColumn("segment_index", F.explode(F.when((F.col("frame") % (span - lap) < lap) & (last > 0), F.array(last - 1, last)).otherwise(F.array(last))))
    segments = cut.select("recording_id", "segment_index").distinct().withColumn("frame_offset", (F.col("segment_index") * (span - lap)).cast("long"))
    emissions = cut.withColumn("frame", (F.col("frame") - F.col("segment_index") * (span - lap)).cast("int"))
    out = api.align(emissions, reference, TOKENIZER, segments, config.AlignmentConfig(drop_exits=True))
    return out.words.select("recording_id", "index", "word", "start_frame", "end_frame", F.round("score", 6).alias("score"))


def preset_families(spark, d):
    return config.presets_by_family(spark).select("family", F.array_join("names", ",").alias("names"), "n")


def statistics_by_source(spark, d):
    """Words of documents over all combinations of language and source."""
    s = table(spark, d, "documents").select("lang", "source", F.size(text.words(F.col("text"))).alias("n"))
    return s.cube("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))


def flagship(spark, d):
    """Stitched tokens as words, with statistics of every recording."""
    tokens = item_tokens(spark, d)
    stitched, holes = stitching.stitch_lis(tokens)
    reference = stitched.where("wid is not null").select("recording_id", F.col("wid").cast("int").alias("idx")).distinct().withColumn("original", F.concat(F.lit("w"), F.col("idx").cast("string"))).withColumn("normalized", F.col("original"))
    return wt.statistics(wt.build_words(stitched, reference), holes=holes)


def pad_samples(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, (F.col("vec_id") % 60 + 1).cast("int")).alias("x"))
    padded = timeline.pad(F.col("x"), F.lit(64))
    return s.select("vec_id", F.size(padded).alias("n"), F.get(padded, F.lit(63)).cast("double").alias("last"), F.get(padded, F.lit(0)).cast("double").alias("first"))


def mono_channels(spark, d):
    halves = F.array(*[F.transform(F.slice("embedding", k, 32), lambda v: v.cast("double")) for k in (1, 33)])
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(timeline.mono_arrays(halves)).alias("i", "v")).withColumn("v", F.round("v", 6))


def resample_samples(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.lit(16000).alias("rate"), F.col("embedding").alias("samples"))
    return timeline.resample(s, target=8000).select("vec_id", "rate", F.size("samples").alias("n"))


def frame_peaks(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("samples"))
    return timeline.frame_peaks(s, ["vec_id"], rate=100, frame=0.1, hop=0.05).withColumn("peak", F.round("peak", 6))


def speech_cuts(spark, d):
    s = order_intervals(spark, d)
    cuts = timeline.speech_to_cuts(s, s.select("recording_id").distinct().withColumn("total", F.lit(2600.0)), ["recording_id"], padding=2.0, keep=5.0)
    return cuts


def chained_maps(spark, d):
    """Times through two cuts, forward and back."""
    first = order_intervals(spark, d)
    second = first.withColumn("start", F.col("start") / 2).withColumn("end", F.col("end") / 2)
    there = timeline.compose_maps(order_times(spark, d), [first, second], ["recording_id"], backward=False)
    return timeline.compose_maps(there.withColumn("there", F.col("time")), [first, second], ["recording_id"]).select("recording_id", "o_orderkey", "there", F.col("time").alias("back"))


def phones_in_words(spark, d):
    """Every event time of a user, in the word of its timeline that holds it."""
    w = timed_words(spark, d).select("recording_id", "index", wt.seconds(F.col("start_frame"), FRAME).alias("a"), wt.seconds(F.col("end_frame"), FRAME).alias("z"))
    p = table(spark, d, "events").select(F.col("user_id").alias("recording_id"), "event_id", (micros("ts") / 1e6 + 2000).alias("at"))
    return range_join(p, w, ["recording_id"], "at", "a", "z", 20 * FRAME).select("recording_id", "event_id", "index")


def pronounce(spark, d):
    from ..functions.tokenizers import PhonemeTokenizer

    known = text.word_table(table(spark, d, "benchmark"), "item_id").select("normalized").distinct()
    spelled = F.filter(F.split("normalized", ""), lambda c: c != "")
    lexicon = known.select(F.col("normalized").alias("word"), F.array(spelled, F.transform(spelled, lambda c: F.concat(c, F.lit("1"))), F.reverse(spelled)).alias("prons"))
    ws = text.word_table(table(spark, d, "documents")).groupBy(F.col("normalized").alias("word")).agg(F.count("*").alias("n"))
    out = PhonemeTokenizer(LABELS).pronounce(ws, lexicon, most=2)
    return out.select("word", "n", F.size("prons").alias("n_prons"), F.array_join(F.get("prons", F.lit(0)), " ").alias("first"))


def decode_styles(spark, d):
    ids = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda v: F.pmod(F.floor(v * 100), F.lit(4)).cast("int")).alias("ids"))
    names = ["a", "|", "▁", "b"]
    return ids.select("vec_id", *[labels.decode_ids(F.col("ids"), names, style).alias(style) for style in ("plain", "pipe", "subword", "shifted")])


def built_words(spark, d):
    """Words of stitched tokens, whose starts and scores are those of their first marks."""
    stitched, _ = stitching.stitch_lis(item_tokens(spark, d))
    reference = stitched.where("wid is not null").select("recording_id", F.col("wid").cast("int").alias("idx")).distinct().withColumn("original", F.concat(F.lit("W"), F.col("idx").cast("string"))).withColumn("normalized", F.lower("original"))
    out = wt.build_words(stitched, reference)
    return out.select("recording_id", "index", "word", "start_frame", "end_frame", F.round("score", 6).alias("score"), "original")


QUERIES = {f.__name__: f for f in (
    pad_samples, mono_channels, resample_samples, frame_peaks, speech_cuts, chained_maps, phones_in_words, pronounce, decode_styles, built_words,
    normalize_basic, mms_words, mms_text, unknown_rate_by_lang, word_count_invariant, number_classes, expand_numbers, expanded_text, split_characters, romanize_aligned,
    char_encode, char_roundtrip, html_text, source_kinds, recover_original, vocabulary, statistics_by_source,
    segment_windows, sliding_counts, event_sessions, silent_runs, silence_cuts, merge_intervals, flip_intervals, time_map, map_to_original, map_to_new, round_trip_times, asof_events, normalize_peak, to_mono,
    word_end_frames, word_gaps, word_statistics, word_coverage, word_seconds, words_at_time, words_in_range, words_by_index, timeline_text, preview_segment, preview_random, sequential_clips, first_words, iou_metrics,
    label_lines, ctm_lines, subtitle_cues, karaoke_lines, textgrid_intervals, json_words, export_files, page_words, clip_bounds,
    flatten_tokens, dedupe_by_position, lis_length, lis_words, stitched_tokens, stitched_holes, remove_outliers, remove_isolated, unaligned_holes, merge_holes,
    edit_distance, edit_steps, diff_steps, diff_statistics, transfer_timestamps,
    log_softmax, greedy_labels, greedy_text, star_and_roll, factor_arcs, ctc_arcs, viterbi_words, segment_decisions, align_items, preset_families, flagship,
)}
