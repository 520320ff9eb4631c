"""Substring deduplication by hashing lines.

A unit is a line that has a word. Its digest is taken from its words (runs of characters other than
space and \\x09-\\x0D, A-Z lower-cased), so blanks don't matter. Digests are grouped over the whole
corpus. The earliest ranked occurrence, by doc_id, then text hash, then position, stays. A later one
goes if it is part of a repeated passage: a run of repeated units of one document, with nothing but
blank lines between, that has at least ``min_words`` words in all. Short lines that recur by chance
in otherwise new text stay. Removed spans keep their original offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .textkit import digests, joined_words, rows, word_spans

MIN_WORDS = 20
UNITS = "doc_id long, h long, unit int, line int, start long, end long, words int, d1 long, d2 long"


def _units(batches):
    for batch in batches:
        for first, last, buf, offsets in rows(batch.column("text")):
            starts, word_ends, _ = word_spans(buf, offsets)
            if not len(starts):
                continue
            breaks = np.flatnonzero(buf == 10)
            # A line begins at each row and after each line break; equal offsets (empty rows) give a line each.
            begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
            begins = begins[: len(offsets) - 1 + len(breaks)]
            stops = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
            row = np.searchsorted(offsets, begins, "right") - 1
            at = np.searchsorted(starts, begins)
            to = np.searchsorted(starts, stops)
            keep = to > at
            begins, stops, row, at, to = begins[keep], stops[keep], row[keep], at[keep], to[keep]
            data, place = joined_words(buf, starts, word_ends)
            digest = digests(data, place[at], place[to]).T
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            line_of = np.searchsorted(breaks, begins) - np.searchsorted(breaks, offsets[row])
            opens = np.concatenate([[True], row[1:] != row[:-1]])
            unit = np.arange(len(row)) - np.maximum.accumulate(np.where(opens, np.arange(len(row)), 0))
            origin = points[offsets[row]]
            taken = pa.array(row + first)
            columns = [batch.column("doc_id").take(taken), batch.column("h").take(taken), unit.astype(np.int32), line_of.astype(np.int32), points[begins] - origin, points[stops] - origin, (to - at).astype(np.int32), *digest]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in UNITS.split(", ")])


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, unit, line, start, end, words`` of every unit that goes; ``h`` is xxhash64 of the text, offsets are code points."""
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(_units, UNITS)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "unit")
    # Written, so that the join has two plain shuffles and a hot digest's partition can be split.
    firsts = written(units.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    later = units.join(firsts, ["d1", "d2"]).where(rank > F.col("first")).drop("d1", "d2", "first").dropDuplicates(["doc_id", "h", "unit"])
    own = Window.partitionBy("doc_id", "h")
    runs = later.withColumn("run", F.col("unit") - F.row_number().over(own.orderBy("unit")))
    total = Window.partitionBy("doc_id", "h", "run")
    return runs.withColumn("total", F.sum("words").over(total)).where(F.col("total") >= min_words).drop("total", "run")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, removed`` of every row: the text without repeated passages.

    ``removed`` lists the removed lines as ``start-end`` in code points of the original text, in
    order, separated by commas. Null texts stay null and have no lines. Rows that agree in doc_id
    and text are one document and lose the same lines; null ids rank last. Other columns are
    ignored; an empty table gives an empty table.
    """
    gone = repeated_units(docs, min_words).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("line", "start", "end"))).alias("gone"))
    gone = gone.withColumnRenamed("doc_id", "g_id").withColumnRenamed("h", "g_h")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    both = own.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    lines = F.split("text", "\n")
    numbers = F.transform("gone", lambda g: g["line"])
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers, i)), "\n"))
    spans = F.array_join(F.transform("gone", lambda g: F.concat_ws("-", g["start"].cast("string"), g["end"].cast("string"))), ",")
    return both.select(
        "doc_id", kept.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.coalesce(spans, F.lit("")).alias("removed"),
    )
