"""Recordings as time series: windows, silence, interval algebra, time maps and sample arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.helpers import asof_join, islands


def segment_windows(recordings: DataFrame, n_samples: str = "n_samples", rate: int = 16000, size: float = 15.0, overlap: float = 2.0, least: float = 0.2, extra: int = 128) -> DataFrame:
    """Adds ``segment_index, offset, length``: overlapping windows, up to the first that reaches the end.

    A last window shorter than ``least`` seconds is left out; so is a whole recording that short.
    """
    width, lap = int(rate * size) + extra, int(rate * overlap) + extra
    step, short = width - lap, int(rate * least)
    if step <= 0:
        raise ValueError("windows must be longer than their overlap")
    n = F.col(n_samples)
    last = F.greatest(F.ceil((n - width) / step), F.lit(0)).cast("long")
    out = recordings.withColumn("segment_index", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))))
    out = out.withColumn("offset", F.col("segment_index") * step).withColumn("length", F.least(F.lit(width), n - F.col("offset")))
    return out.where(F.col("length") >= short).withColumn("segment_index", F.col("segment_index").cast("int"))


def frame_offset(offset: Column, rate: int = 16000, frame_duration: float = 0.02) -> Column:
    """Whole frames before a sample offset."""
    return F.floor(offset / F.lit(round(rate * frame_duration, 6))).cast("long")


def pad(samples: Column, width: Column) -> Column:
    """Samples with zeros behind, up to ``width``."""
    return F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(width - F.size(samples), F.lit(0)).cast("int")))


def to_mono(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The mean over channels of every sample."""
    return samples.groupBy(*by).agg(F.avg(value).alias(value))


def mono_arrays(channels: Column) -> Column:
    """The mean over channels of array<array<double>>."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, 2, F.greatest(n - 1, F.lit(0))), F.get(channels, F.lit(0)), lambda acc, c: F.zip_with(acc, c, lambda a, b: a + b))
    return F.transform(total, lambda v: v / n)


def normalize_peak(samples: DataFrame, by: list[str], value: str = "value", target_db: float = -3.0) -> DataFrame:
    """Scales each recording so that its greatest absolute sample is the target level; silence stays."""
    peak = F.max(F.abs(value)).over(Window.partitionBy(*by))
    return samples.withColumn("_peak", peak).withColumn(value, F.when(F.col("_peak") > 0, F.col(value) * (10 ** (target_db / 20)) / F.col("_peak")).otherwise(F.col(value))).drop("_peak")


def resample(recordings: DataFrame, rate: str = "rate", samples: str = "samples", target: int = 16000, taps: int = 16) -> DataFrame:
    """Windowed-sinc resampling of ``samples array<float>``; equal rates stay as they are. One row at a time, no grouping."""

    def one(x: np.ndarray, source: int) -> np.ndarray:
        if source == target or not len(x):
            return x
        cut = min(1.0, target / source)
        n = int(np.ceil(len(x) * target / source))
        at = np.arange(n) * source / target
        half = int(np.ceil(taps / cut))
        index = np.floor(at).astype(int)[:, None] + np.arange(-half, half + 1)
        gap = at[:, None] - index
        kernel = cut * np.sinc(cut * gap) * np.where(np.abs(gap) <= half, np.cos(np.pi * gap / (2 * half)) ** 2, 0)
        held = np.where((index >= 0) & (index < len(x)), x[np.clip(index, 0, len(x) - 1)], 0)
        return (held * kernel).sum(1)

    def run(batches):
        for pdf in batches:
            pdf[samples] = [one(np.asarray(x, float), int(r)).astype(np.float32) for x, r in zip(pdf[samples], pdf[rate], strict=True)]
            pdf[rate] = target
            yield pdf

    return recordings.mapInPandas(run, recordings.schema)


def preprocess(samples: DataFrame, steps: list) -> DataFrame:
    """Applies DataFrame-to-DataFrame steps in order."""
    for step in steps:
        samples = samples.transform(step)
    return samples


def silent_runs(frames: DataFrame, by: list[str], order: str, silent: Column) -> DataFrame:
    """Runs of consecutive silent frames: ``by, first, last, n``."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = frames.withColumn("_silent", silent).withColumn("_before", F.lag("_silent").over(w))
    runs = islands(marked, by, [order], F.col("_before").isNull() | (F.col("_before") != F.col("_silent")), "_run")
    return runs.where("_silent").groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def silence_intervals(frames: DataFrame, by: list[str], frame: str = "frame", peak: str = "peak", hop: float = 0.01, threshold_db: float = -50.0, least: float = 0.2, padding: float = 0.1, keep: float = 0.4, totals: DataFrame | None = None) -> DataFrame:
    """Silence to cut: runs below the threshold of at least ``least`` seconds, shrunk by ``padding`` on both sides, if at least ``keep`` seconds are left.

    With ``totals(by, total)`` a run that reaches the last frame ends with its recording.
    """
    runs = silent_runs(frames, by, frame, F.col(peak) < 10 ** (threshold_db / 20))
    end = (F.col("last") + 1) * hop
    if totals is not None:
        ends = frames.groupBy(*by).agg(F.max(frame).alias("_final"))
        runs = runs.join(ends, by).join(totals, by)
        end = F.when(F.col("last") == F.col("_final"), F.col("total")).otherwise(end)
    runs = runs.select(*by, (F.col("first") * hop).alias("start"), end.alias("end")).where(F.col("end") - F.col("start") >= least)
    return runs.select(*by, (F.col("start") + padding).alias("start"), (F.col("end") - padding).alias("end")).where(F.col("end") - F.col("start") >= keep)


def frame_peaks(recordings: DataFrame, by: list[str], samples: str = "samples", rate: int = 16000, frame: float = 0.02, hop: float = 0.01) -> DataFrame:
    """Greatest absolute sample of each analysis frame; the frame that would touch the end is left out."""
    width, step = int(rate * frame), int(rate * hop)
    starts = F.when(F.size(samples) > width, F.sequence(F.lit(0), F.size(samples) - width - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    spread = recordings.select(*by, samples, F.posexplode(starts).alias("frame", "_at"))
    return spread.select(*by, "frame", F.array_max(F.transform(F.slice(samples, F.col("_at") + 1, width), F.abs)).alias("peak"))


def merge_intervals(intervals: DataFrame, by: list[str], gap: float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that overlap, touch, or lie at most ``gap`` apart become one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_reach", reach)
    runs = islands(marked, by, [start, end], F.col("_reach").isNull() | (F.col(start) - F.col("_reach") > gap), "_run")
    return runs.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def flip_intervals(intervals: DataFrame, totals: DataFrame, by: list[str], total: str = "total") -> DataFrame:
    """The rest of [0, total] of every recording; one without intervals gives all of it."""
    merged = merge_intervals(intervals, by)
    ends = merged.select(*by, F.col("end").alias("start")).unionByName(totals.select(*by, F.lit(0.0).alias("start")))
    nexts = merged.select(*by, F.col("start").alias("next"))
    marks = ends.select(*by, "start", F.lit(None).cast("double").alias("next")).unionByName(nexts.select(*by, F.lit(None).cast("double").alias("start"), "next"))
    ordered = marks.withColumn("_at", F.coalesce("start", "next"))
    # At one place a rest begins before a cut does: such a rest is empty.
    after = Window.partitionBy(*by).orderBy("_at", F.col("start").isNull()).rowsBetween(1, Window.unboundedFollowing)
    paired = ordered.withColumn("end", F.first("next", ignorenulls=True).over(after)).where(F.col("start").isNotNull())
    return paired.join(totals.select(*by, F.col(total).alias("_total")), by).withColumn("end", F.coalesce("end", "_total")).where(F.col("end") > F.col("start")).select(*by, "start", "end")


def time_map(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Prefix table of cut intervals: ``by, new_time, original`` at the end of each; ``new_time`` is the time kept before it."""
    merged = merge_intervals(intervals, by)
    w = Window.partitionBy(*by).orderBy("start")
    before = F.coalesce(F.lag("end").over(w), F.lit(0.0))
    held = merged.withColumn("_kept", F.col("start") - before)
    return held.select(*by, F.sum("_kept").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("new_time"), F.col("end").alias("original"))


def map_to_original(times: DataFrame, intervals: DataFrame, by: list[str], time: str = "time", out: str = "original_time") -> DataFrame:
    """Times after cutting, as times before it, by an as-of lookup in the prefix table."""
    table = time_map(intervals, by).select(*by, F.col("new_time").alias("_new"), F.col("original").alias("_old"))
    held = asof_join(times, table, by, time, "_new", ["_new", "_old"])
    return held.withColumn(out, F.when(F.col("_old").isNull(), F.col(time)).otherwise(F.col("_old") + F.col(time) - F.col("_new"))).drop("_new", "_old")


def map_to_new(times: DataFrame, intervals: DataFrame, by: list[str], time: str = "time", out: str = "new_time") -> DataFrame:
    """Times before cutting, as times after it; a time inside a cut goes to the cut's start."""
    merged = merge_intervals(intervals, by)
    w = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    table = merged.select(*by, F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)).alias("_cut"), F.col("start").alias("_a"), F.col("end").alias("_z"))
    held = asof_join(times, table, by, time, "_a", ["_a", "_z", "_cut"])
    moved = F.col(time) - F.col("_cut") - (F.least(F.col(time), F.col("_z")) - F.col("_a"))
    return held.withColumn(out, F.when(F.col("_a").isNull(), F.col(time)).otherwise(moved)).drop("_a", "_z", "_cut")


def compose_maps(times: DataFrame, stages: list[DataFrame], by: list[str], time: str = "time", backward: bool = True) -> DataFrame:
    """Through several cuts: back to the first recording, or forward to the last."""
    for cut in reversed(stages) if backward else stages:
        times = (map_to_original if backward else map_to_new)(times, cut, by, time, "_mapped").drop(time).withColumnRenamed("_mapped", time)
    return times


def cut_intervals(samples: DataFrame, intervals: DataFrame, by: list[str], time: str = "time") -> DataFrame:
    """The samples outside all intervals."""
    merged = merge_intervals(intervals, by)
    held = asof_join(samples, merged.select(*by, F.col("start").alias("cut_start"), F.col("end").alias("cut_end")), by, time, "cut_start", ["cut_start", "cut_end"])
    return held.where(F.col("cut_end").isNull() | (F.col(time) >= F.col("cut_end"))).drop("cut_start", "cut_end")


def speech_to_cuts(speech: DataFrame, totals: DataFrame, by: list[str], padding: float = 0.1, keep: float = 0.4) -> DataFrame:
    """Of detected speech, the pauses to cut: the rest of the recording, shrunk by ``padding``, of at least ``keep`` seconds."""
    rest = flip_intervals(speech, totals, by)
    return rest.select(*by, (F.col("start") + padding).alias("start"), (F.col("end") - padding).alias("end")).where(F.col("end") - F.col("start") >= keep)


def enhance(recordings: DataFrame, steps: list[str], registry: dict) -> DataFrame:
    """Named steps of the registry, in order; an unknown one raises ValueError."""
    unknown = [s for s in steps if s not in registry]
    if unknown:
        raise ValueError(f"no such step: {', '.join(unknown)}; there are {sorted(registry)}")
    return preprocess(recordings, [registry[s] for s in steps])


def per_recording(recordings: DataFrame, function, schema: str) -> DataFrame:
    """A hook for models and codecs: ``function(pandas.DataFrame) -> pandas.DataFrame`` over Arrow batches of rows."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(function(pdf))

    return recordings.mapInPandas(run, schema)
