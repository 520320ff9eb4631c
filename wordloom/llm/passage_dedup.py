"""Substring deduplication: repeated lines, and passages of ``PASSAGE`` words that repeat anywhere in a text.

Lines go by ``line_dedup``. Besides them, every run of ``PASSAGE`` words (a window) whose words occur earlier,
by doc_id, then text hash, then position, goes, wherever lines break; the earliest occurrence stays. A window
that overlaps its own earliest occurrence stays too.

Digests of all windows would outgrow the texts, so candidates come first: the least hash of the ``GRAM``-word
shingles in a window (its anchor) depends on its words only, so equal windows have equal anchors. Only windows
whose anchor occurs twice count; none that repeats is lost. Neighbouring windows with one anchor are a run. Of
runs with equal words the earliest alone is cut into windows, which get digests; the others go whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import repeated_units
from .shared import written
from .textkit import U64, digests, joined_words, mix, rows, span_hash, word_spans

PASSAGE, GRAM = 50, 25
#: Windows that one shingle can be the anchor of; a longer run of equal anchors repeats within itself.
REACH = PASSAGE - GRAM + 1
_LEFT = U64(0xD1342543DE82EF95)
ANCHORS = "doc_id long, h long, p int, n int, a long, r long"
WINDOWS = "doc_id long, h long, p int, d1 long, d2 long"
CUT = "doc_id long, text string, n_lines long, n_removed long, n_passages long, removed string"


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, put together from those of powers of two."""
    out, have, part, width = None, 0, words, 1
    while True:
        if size & width:
            out = part if out is None else mix(out[: len(part) - have] * _LEFT + part[have : have + len(out)])
            have += width
            out = out[: len(words) - have + 1]
        width *= 2
        if width > size:
            return out
        part = mix(part[: len(part) - width // 2] * _LEFT + part[width // 2 :])


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in names.split(", ")])


def _anchors(batches):
    """Runs of ``n`` windows from word ``p`` that have one anchor ``a``, and a hash ``r`` of all words of the run."""
    for batch in batches:
        for first, _, buf, offsets in rows(batch.column("text")):
            starts, ends, at = word_spans(buf, offsets)
            number = np.maximum(np.diff(at) - PASSAGE + 1, 0)
            if not number.any():
                continue
            words = span_hash(buf, starts, ends, fold=True)
            least = _grams(words, GRAM)
            width = 1
            while 2 * width <= REACH:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[: len(least) - REACH + width], least[REACH - width :])
            row = np.repeat(np.arange(len(number)), number)
            begin = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + at[:-1][row]
            anchor = least[begin]
            opens = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
            taken = pa.array(row[opens] + first)
            p, n = (begin - at[:-1][row])[opens], np.diff(np.append(opens, len(row)))
            data, place = joined_words(buf, starts, ends)
            whole = digests(data, place[begin[opens]], place[begin[opens] + n + PASSAGE - 1])[:, 0]
            yield _batch(ANCHORS, batch.column("doc_id").take(taken), batch.column("h").take(taken), p.astype(np.int32), n.astype(np.int32), anchor[opens].view(np.int64), whole)


def _windows(batches):
    """Digests of the windows in ``runs`` of every text."""
    for batch in batches:
        for first, last, buf, offsets in rows(batch.column("text")):
            starts, ends, at = word_spans(buf, offsets)
            data, place = joined_words(buf, starts, ends)
            runs = batch.column("runs").slice(first, last - first)
            own = np.repeat(np.arange(last - first), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
            flat = runs.flatten()
            p, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            row = np.repeat(own, n)
            p = np.repeat(p, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = p + at[:-1][row]
            digest = digests(data, place[begin], place[begin + PASSAGE]).T
            taken = pa.array(row + first)
            yield _batch(WINDOWS, batch.column("doc_id").take(taken), batch.column("h").take(taken), p.astype(np.int32), *digest)


def _cuts(text: str, lines: list[int], windows: list[dict]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without these lines and windows, the spans that went, in code points, and the number of runs of words that windows cover.

    A line that loses all its words goes with its break, any other loses the words only.
    """
    data = text.encode()
    buf = np.frombuffer(data, np.uint8)
    starts, ends, _ = word_spans(buf, np.array([0, len(buf)]))
    depth = np.zeros(len(starts) + 1, np.int64)
    for w in windows:
        depth[w["p"]] += 1
        depth[w["p"] + w["n"] + PASSAGE - 1] -= 1
    gone = np.cumsum(depth)[:-1] > 0
    passages = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    breaks = np.flatnonzero(buf == 10)
    begins, stops = np.concatenate([[0], breaks + 1]), np.append(breaks, len(buf))
    at, to = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    for i in lines:
        gone[at[i] : to[i]] = True
    lost = np.concatenate([[0], np.cumsum(gone)])
    spans, kept = [], []
    for a, z, low, high in zip(begins.tolist(), stops.tolist(), at.tolist(), to.tolist(), strict=True):
        count = int(lost[high] - lost[low])
        if count and count == high - low:
            spans.append((a, z))
            continue
        parts, place = [], a
        if count:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[low:high].view(np.int8), [0]])))
            for x, y in zip((edge[::2] + low).tolist(), (edge[1::2] + low).tolist(), strict=True):
                parts.append(data[place : starts[x]])
                place = int(ends[y - 1])
                spans.append((int(starts[x]), place))
        kept.append(b"".join([*parts, data[place:z]]))
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return b"\n".join(kept).decode(), [(int(points[a]), int(points[z])) for a, z in spans], passages


def _cut(batches):
    for batch in batches:
        column = batch.column("text")
        n_lines = pc.fill_null(pc.add(pc.count_substring(column, "\n"), 1), 0).cast(pa.int64())
        texts, removed, count, passages = column, [""] * len(batch), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        touched = np.flatnonzero(batch.column("lines").is_valid().to_numpy(zero_copy_only=False))
        if len(touched):
            texts = column.to_pylist()
            for i in touched.tolist():
                texts[i], spans, passages[i] = _cuts(texts[i], batch.column("lines")[i].as_py(), batch.column("windows")[i].as_py())
                count[i], removed[i] = len(spans), ",".join(f"{a}-{z}" for a, z in spans)
            texts = pa.array(texts, pa.string())
        yield _batch(CUT, batch.column("doc_id"), texts, n_lines, count, passages, pa.array(removed, pa.string()))


def _beside(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """Joins by document, null ids too."""
    more = more.withColumnRenamed("doc_id", "m_id").withColumnRenamed("h", "m_h")
    return docs.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), how).drop("m_id", "m_h")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, h, p, n`` of all windows of ``docs`` (``doc_id, h, text``) that go; ``p`` is the first word of the first of ``n``."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "p")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    near = own & (F.col("p") < F.col("first.p") + PASSAGE)
    anchors = written(docs.mapInArrow(_anchors, ANCHORS), "anchors")
    shared = written(anchors.groupBy("a").agg(F.sum(F.ceil(F.col("n") / REACH)).alias("c")).where("c > 1").select("a"), "shared")
    marked = written(anchors.join(shared, "a"), "marked")
    firsts = written(marked.groupBy("a", "r").agg(F.min(rank).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first_runs")
    # A run near its first (itself too) is cut into windows as well.
    runs = written(marked.join(firsts, ["a", "r"], "left").select("doc_id", "h", "p", "n", (F.col("first").isNull() | near).alias("cut")), "runs")
    cut = runs.where("cut").groupBy("doc_id", "h").agg(F.collect_set(F.struct("p", "n")).alias("runs"))
    windows = written(_beside(docs.where("text is not null"), cut, "inner").mapInArrow(_windows, WINDOWS), "windows")
    first_windows = written(windows.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "first_windows")
    later = windows.join(first_windows, ["d1", "d2"]).where((rank > F.col("first")) & ~near).select("doc_id", "h", "p", F.lit(1).alias("n"))
    return later.union(runs.where("not cut").select("doc_id", "h", "p", "n"))


def dedup_passages(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, n_passages, removed`` of every row: the text without repeated lines and passages.

    ``n_passages`` counts the longest runs of words that later windows of ``PASSAGE`` words cover. ``removed`` lists the removed spans as ``start-end`` in code points of the original text, in order,
    separated by commas: a whole line, or words within one. ``min_words`` is that of repeated runs of
    lines. Null texts stay null and have no lines. Rows that agree in doc_id and text are one document
    and lose the same spans; null ids rank last. Other columns are ignored; an empty table gives an
    empty table.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    lines = repeated_units(docs, min_words).select("doc_id", "h", "line", F.lit(None).cast("struct<p:int,n:int>").alias("w"))
    windows = repeated_windows(own).select("doc_id", "h", F.lit(None).cast("int").alias("line"), F.struct("p", "n").alias("w"))
    gone = written(lines.unionByName(windows).groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines"), F.collect_set("w").alias("windows")), "gone")
    return _beside(own, gone, "left").select("doc_id", "text", "lines", "windows").mapInArrow(_cut, CUT)
