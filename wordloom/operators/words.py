"""Word timelines: ``recording_id, index, word, start_frame, end_frame, score`` with an optional ``original``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.helpers import ordered_concat, range_join

BY = ["recording_id"]
FRAME_DURATION = 0.02


def seconds(frame: Column, frame_duration=FRAME_DURATION) -> Column:
    return frame.cast("double") * F.lit(frame_duration)


def with_seconds(words: DataFrame, frame_duration=FRAME_DURATION) -> DataFrame:
    """Adds ``start_s, end_s, duration_s, duration_frames, confidence, display``."""
    start, end = seconds(F.col("start_frame"), frame_duration), seconds(F.col("end_frame"), frame_duration)
    out = words.withColumn("start_s", start).withColumn("end_s", end).withColumn("duration_frames", F.col("end_frame") - F.col("start_frame"))
    out = out.withColumn("duration_s", seconds(F.col("duration_frames"), frame_duration)).withColumn("confidence", F.col("score"))
    return out.withColumn("display", display_text(F.col("word"), F.col("original")) if "original" in words.columns else F.col("word"))


def display_text(word: Column, original: Column) -> Column:
    """``original (word)`` where the original is another form, else the word."""
    return F.when((original != "") & (original != word), F.format_string("%s (%s)", original, word)).otherwise(word)


def end_frames(words: DataFrame, by: list[str] = BY, index: str = "index", most: int = 50, least: int = 5, default: float = 2.5) -> DataFrame:
    """Adds ``end_frame`` to words with starts only.

    A gap of at most ``most`` frames to the next start is the word's length. Otherwise, and for the
    last word, the length is estimated from the recording's frames a character over such gaps
    (``default`` if there are none) and kept between ``least`` and ``most``.
    """
    w = Window.partitionBy(*by)
    size = F.length("word")
    out = words.withColumn("_gap", F.lead("start_frame").over(w.orderBy(index)) - F.col("start_frame"))
    rate = F.coalesce(F.avg(F.when((F.col("_gap") > 0) & (F.col("_gap") <= most) & (size > 0), F.col("_gap") / size)).over(w), F.lit(default))
    guess = F.when(size > 0, F.greatest(F.lit(least), F.least((size * rate).cast("long"), F.lit(most)))).otherwise(F.lit(least))
    return out.withColumn("_guess", guess).withColumn("end_frame", F.col("start_frame") + F.when(F.col("_gap") <= most, F.col("_gap")).otherwise(F.col("_guess"))).drop("_gap", "_guess")


def build_words(tokens: DataFrame, reference: DataFrame, by: list[str] = BY, blank: int = 0) -> DataFrame:
    """Words of stitched tokens ``by, ord, token_id, frame, score, wid, tk`` and ``reference(by, idx, original, normalized)``.

    A token with a word id opens the word; the following ones without belong to it. The first start of
    a word counts, tokens of repeats add to its score, which is the mean over its non-blank tokens.
    Word ids past the end are dropped.
    """
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    owned = tokens.withColumn("word_id", F.last("wid", ignorenulls=True).over(w)).where("word_id is not null")
    real = F.when((F.col("token_id") != blank) & F.col("tk").isNotNull(), F.col("score"))
    starts = owned.groupBy(*by, "word_id").agg(F.min_by("frame", "ord").alias("start_frame"), F.coalesce(F.avg(real), F.lit(0.0)).alias("score"))
    named = starts.join(reference.select(*by, F.col("idx").cast("long").alias("word_id"), "original", F.col("normalized").alias("word")), [*by, "word_id"])
    original = F.when((F.col("word") == "*") | (F.lower("original") != F.lower("word")), F.col("original"))
    return end_frames(named.withColumnRenamed("word_id", "index").withColumn("original", original), by)


def gaps(words: DataFrame, by: list[str] = BY, index: str = "index") -> DataFrame:
    """Adds ``gap``: frames between the end of the word before and this start; null for the first word."""
    return words.withColumn("gap", F.col("start_frame") - F.lag("end_frame").over(Window.partitionBy(*by).orderBy(index)))


def statistics(words: DataFrame, by: list[str] = BY, index: str = "index", frame_duration=FRAME_DURATION, totals: DataFrame | None = None, holes: DataFrame | None = None) -> DataFrame:
    """One row a recording: counts, time range, durations (the median is the upper one), confidence over positive scores, positive gaps.

    ``totals(by, total_words, audio_duration)`` adds coverage; ``holes`` adds the number of unaligned regions.
    """
    s = gaps(words, by, index).withColumn("d", (F.col("end_frame") - F.col("start_frame")) * F.lit(frame_duration)).withColumn("g", F.when(F.col("gap") > 0, F.col("gap") * F.lit(frame_duration)))
    sure = F.when(F.col("score") > 0, F.col("score"))
    out = s.groupBy(*by).agg(
        F.count("*").alias("num_words"), (F.min_by("start_frame", index) * F.lit(frame_duration)).alias("start"), (F.max_by("end_frame", index) * F.lit(frame_duration)).alias("end"),
        F.avg("d").alias("duration_mean"), F.min("d").alias("duration_min"), F.max("d").alias("duration_max"),
        F.sort_array(F.collect_list("d")).alias("_d"), F.avg(sure).alias("confidence_mean"), F.min(sure).alias("confidence_min"), F.max(sure).alias("confidence_max"), F.count(sure).alias("words_with_score"),
        F.count("g").alias("gap_count"), F.sum("g").alias("gap_total"), F.avg("g").alias("gap_mean"), F.max("g").alias("gap_max"),
    ).withColumn("duration_median", F.get("_d", F.floor(F.size("_d") / 2).cast("int"))).drop("_d")
    if totals is not None:
        out = out.join(totals, by, "left")
        if "total_words" in totals.columns:
            out = out.withColumn("coverage_percent", 100.0 * F.col("num_words") / F.col("total_words"))
        if "audio_duration" in totals.columns:
            out = out.withColumn("aligned_time_percent", 100.0 * (F.col("end") - F.col("start")) / F.col("audio_duration"))
    if holes is not None:
        out = out.join(holes.groupBy(*by).agg(F.count("*").alias("num_unaligned_regions")), by, "left").fillna(0, ["num_unaligned_regions"])
    return out


def summary(stats: DataFrame) -> DataFrame:
    """The statistics as a short text."""
    line = F.format_string("%d words, %.2f s to %.2f s; mean word %.3f s, median %.3f s; %d gaps", "num_words", "start", "end", "duration_mean", "duration_median", "gap_count")
    return stats.withColumn("summary", line)


def words_at(times: DataFrame, words: DataFrame, by: list[str] = BY, time: str = "time", frame_duration=FRAME_DURATION, bucket: float = 1.0) -> DataFrame:
    """The first word of each time point, both ends included: ``by, time, index, word``. Times in no word have none."""
    spans = words.select(*by, "index", "word", seconds(F.col("start_frame"), frame_duration).alias("_a"), seconds(F.col("end_frame"), frame_duration).alias("_z"))
    found = range_join(times, spans, by, time, "_a", "_z", bucket, closed=True)
    return found.groupBy(*by, time).agg(F.min_by(F.struct("index", "word"), "index").alias("w")).select(*by, time, "w.index", "w.word")


def words_in_range(words: DataFrame, low: float, high: float, frame_duration=FRAME_DURATION) -> DataFrame:
    """Words that start in [low, high] seconds."""
    return words.where(seconds(F.col("start_frame"), frame_duration).between(low, high))


def by_index(words: DataFrame, by: list[str] = BY, order: str = "start_frame") -> DataFrame:
    """The last word of every index from 0."""
    return words.where("index >= 0").groupBy(*by, "index").agg(F.max_by(F.struct(*[F.col(c) for c in words.columns if c not in (*by, "index")]), order).alias("w")).select(*by, "index", "w.*")


def with_position(words: DataFrame, by: list[str] = BY, order: str = "start_frame") -> DataFrame:
    """Adds ``position``, from 0."""
    return words.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def text(words: DataFrame, by: list[str] = BY, order: str = "index", frame_duration=FRAME_DURATION) -> DataFrame:
    """``by, text, duration, num_words``."""
    length = (F.max_by("end_frame", order) - F.min_by("start_frame", order)) * F.lit(frame_duration)
    return words.groupBy(*by).agg(ordered_concat("word", order, " ").alias("text"), length.alias("duration"), F.count("*").alias("num_words"))


def preview(words: DataFrame, first: int, count: int = 20, by: list[str] = BY, rate: int = 16000, frame_duration=FRAME_DURATION, padding: float = 0.0) -> DataFrame:
    """Bounds and text of ``count`` words from position ``first``: seconds and samples, padded and not below 0."""
    picked = with_position(words, by, "index").where(F.col("position").between(first, first + count - 1))
    out = picked.groupBy(*by).agg(F.min("start_frame").alias("_a"), F.max("end_frame").alias("_z"), ordered_concat("word", "position", " ").alias("text"), F.count("*").alias("n"))
    out = out.withColumn("start_s", F.greatest(seconds(F.col("_a"), frame_duration) - padding, F.lit(0.0))).withColumn("end_s", seconds(F.col("_z"), frame_duration) + padding)
    return out.withColumn("start_sample", (F.col("start_s") * rate).cast("long")).withColumn("end_sample", (F.col("end_s") * rate).cast("long")).drop("_a", "_z")


def preview_random(words: DataFrame, count: int = 30, seed: int = 0, by: list[str] = BY) -> DataFrame:
    """A run of ``count`` consecutive words a recording, from a place that the seed fixes."""
    w = Window.partitionBy(*by)
    out = with_position(words, by, "index").withColumn("_n", F.count("*").over(w))
    draw = F.pmod(F.xxhash64(*by, F.lit(seed)), F.greatest(F.col("_n") - count + 1, F.lit(1)))
    return out.withColumn("_first", draw).where(F.col("position").between(F.col("_first"), F.col("_first") + count - 1)).drop("_n", "_first")


def sequential_clips(words: DataFrame, first: int = 0, count: int = 10, by: list[str] = BY, frame_duration=FRAME_DURATION, tail: float = 0.3) -> DataFrame:
    """One clip a word, up to the next word's start; the last one ends ``tail`` seconds after its word."""
    picked = with_position(words, by, "index").where(F.col("position").between(first, first + count - 1))
    nexts = F.lead("start_frame").over(Window.partitionBy(*by).orderBy("position"))
    end = F.coalesce(seconds(nexts, frame_duration), seconds(F.col("end_frame"), frame_duration) + tail)
    return picked.select(*by, "position", "word", seconds(F.col("start_frame"), frame_duration).alias("start_s"), end.alias("end_s"))


def first_words(words: DataFrame, most: int = 50, by: list[str] = BY) -> DataFrame:
    """The first ``most`` words of each recording, by index."""
    return with_position(words, by, "index").where(F.col("position") < most)


def accuracy(found: DataFrame, truth: DataFrame, by: list[str] = BY, frame_duration=FRAME_DURATION) -> DataFrame:
    """Per recording, over words with the same index: mean start error in milliseconds and mean overlap (intersection over union)."""
    t = truth.select(*by, "index", F.col("start_frame").alias("ts"), F.col("end_frame").alias("te"))
    both = found.select(*by, "index", "start_frame", "end_frame").join(t, [*by, "index"])
    meet = F.greatest(F.least("end_frame", "te") - F.greatest("start_frame", "ts"), F.lit(0))
    union = (F.col("end_frame") - F.col("start_frame")) + (F.col("te") - F.col("ts")) - meet
    iou = F.when(union > 0, meet / union).otherwise(0.0)
    return both.groupBy(*by).agg((F.avg(F.abs(F.col("start_frame") - F.col("ts"))) * frame_duration * 1000).alias("start_error_ms"), F.avg(iou).alias("mean_iou"), F.count("*").alias("n"))
