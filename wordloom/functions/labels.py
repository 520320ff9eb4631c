"""Frame label scores (emissions): array<float> a frame, label ids from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.helpers import let, ordered_concat

STAR_SCORE = -5.0


def log_softmax(x: Column) -> Column:
    """Log-probabilities of an array of scores."""
    top = F.array_max(x)
    total = lambda m: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - m))
    return let(top.cast("double"), lambda m: let(F.ln(total(m)) + m, lambda z: F.transform(x, lambda v: v.cast("double") - z)))


def roll_blank(x: Column) -> Column:
    """The last score (the blank of some models) moved to the front."""
    return F.concat(F.slice(x, -1, 1), F.slice(x, 1, F.size(x) - 1))


def add_star(x: Column, score: float = STAR_SCORE) -> Column:
    """A column for any label at a fixed log-probability."""
    return F.concat(x, F.array(F.lit(score).cast("double")))


def best_label(x: Column) -> Column:
    """Position of the greatest score, the first if equal."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def output_length(samples: Column, samples_in: Column, frames_out: Column) -> Column:
    """Frames that hold real input after padding: whole input samples by samples a frame, at most the frames there are."""
    return F.least(F.floor(samples / (samples_in / frames_out)), frames_out).cast("long")


def greedy_labels(frames: DataFrame, by: list[str], frame: str = "frame", scores: str = "logp", blank: int = 0) -> DataFrame:
    """Best label of each frame, repeats collapsed, then blanks dropped: ``by, pos, frame, label_id``."""
    w = Window.partitionBy(*by).orderBy(frame)
    picked = frames.select(*by, frame, best_label(F.col(scores)).alias("label_id")).withColumn("before", F.lag("label_id").over(w))
    kept = picked.where(F.col("before").isNull() | (F.col("before") != F.col("label_id"))).where(F.col("label_id") != blank)
    return kept.select(*by, (F.row_number().over(w) - 1).alias("pos"), frame, "label_id")


def greedy_text(frames: DataFrame, by: list[str], labels: list[str], **options) -> DataFrame:
    """The decoded string of each group; unknown ids add nothing. Groups without a label have none."""
    held = F.array(*[F.lit(x) for x in labels])
    found = greedy_labels(frames, by, **options).withColumn("token", F.coalesce(F.get(held, F.col("label_id")), F.lit("")))
    return found.groupBy(*by).agg(ordered_concat("token", "pos", "").alias("text"))


def decode_ids(ids: Column, labels: list[str], style: str = "plain") -> Column:
    """Ids as text. ``plain`` joins labels; ``pipe`` takes | as a blank; ``subword`` takes ▁ as a blank; ``shifted`` also counts ids from 1."""
    held = F.array(*[F.lit(x) for x in labels])
    offset = 1 if style == "shifted" else 0
    joined = F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(held, i - offset), F.lit(""))), "")
    if style == "plain":
        return joined
    return F.trim(F.regexp_replace(F.replace(joined, F.lit("|" if style == "pipe" else "▁"), F.lit(" ")), " +", " "))
