"""Overlapping segments of tokens into one word timeline.

Tokens: ``recording_id, segment_index, pos, token_id, frame, score, wid, tk``. Sequential algorithms
(longest increasing subsequence, isolated words, edit distance, diff) run in grouped pandas functions
over one recording's pruned columns; all the rest are windows and joins.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.helpers import islands

BY = "recording_id"


def flatten_tokens(segments: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Segments with nested tokens, as one row a token with its segment; rejected segments are left out."""
    kept = segments.where(~F.col("rejected")) if "rejected" in segments.columns else segments
    return kept.select(BY, "segment_index", F.posexplode(tokens).alias("pos", "token")).select(BY, "segment_index", "pos", "token.*")


def word_indices(tokens: DataFrame) -> DataFrame:
    """The tokens that carry a word id."""
    return tokens.where("wid is not null")


def with_order(tokens: DataFrame) -> DataFrame:
    """Adds ``ord``: the token's place in its recording, from 0."""
    return tokens.withColumn("ord", F.row_number().over(Window.partitionBy(BY).orderBy("segment_index", "pos")) - 1)


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting from the last pile back."""
    tails, places, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            places.append(i)
        else:
            tails[k], places[k] = v, i
        before[i] = places[k - 1] if k else -1
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def drop_isolated(ids: list[int], size: int = 5, share: float = 0.4) -> list[int]:
    """Ids without those whose left and right neighbourhoods both hold less than ``share`` of what they could; removals count at once."""
    if not ids:
        return []
    low, high, held = ids[0], ids[-1], set(ids)
    for i in sorted(held):
        left, right = i - max(i - size, low), min(i + size, high) - i
        if left > 0 and right > 0:
            near_left = sum(j in held for j in range(i - size, i))
            near_right = sum(j in held for j in range(i + 1, i + size + 1))
            if near_left < share * left and near_right < share * right:
                held.discard(i)
    return [i for i in ids if i in held]


def _cut_outliers(v: list[int], scan: int, jump: int) -> list[int]:
    if len(v) <= 10:
        return v
    reach = min(scan, len(v) // 2 - 1)
    gap = np.diff(v)
    head = [i for i in range(1, reach + 1) if gap[i - 1] > jump]
    tail = [i for i in range(len(v) - reach, len(v)) if gap[i - 1] > jump]
    return v[head[-1] if head else 0 : tail[0] if tail else len(v)]


def lis_words(tokens: DataFrame, scan: int = 100, jump: int = 60, size: int = 5, share: float = 0.4, filters: bool = True) -> DataFrame:
    """``recording_id, ord, wid``: the tokens that carry the stitched word sequence.

    The longest increasing subsequence of word ids, without outliers at both ends and isolated words;
    each id is then marked at its leftmost occurrence that keeps the order. ``tokens`` need ``ord``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        wid, order = pdf["wid"].tolist(), pdf["ord"].tolist()
        chosen = [wid[i] for i in longest_increasing(wid)]
        if filters:
            chosen = drop_isolated(_cut_outliers(chosen, scan, jump), size, share)
        marked, j = [], 0
        for k, w in zip(order, wid, strict=True):
            if j < len(chosen) and w == chosen[j]:
                marked.append((k, w))
                j += 1
        out = pd.DataFrame(marked, columns=["ord", "wid"])
        out.insert(0, BY, pdf[BY].iloc[0])
        return out

    kept = word_indices(tokens).select(BY, F.col("ord").cast("long").alias("ord"), F.col("wid").cast("long").alias("wid"))
    kind = kept.schema[BY].dataType.simpleString()
    return kept.groupBy(BY).applyInPandas(run, f"{BY} {kind}, ord long, wid long")


def remove_outliers(ids: DataFrame, by: list[str], order: str, value: str, scan: int = 100, jump: int = 60) -> DataFrame:
    """Cuts the head before its last big jump and the tail from its first; sequences of up to ten stay. Windows only."""
    w = Window.partitionBy(*by)
    s = ids.withColumn("_rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_gap", F.col(value) - F.lag(value).over(w.orderBy(order)))
    reach = F.least(F.lit(scan), F.floor(F.col("_n") / 2).cast("int") - 1)
    big = F.col("_gap") > jump
    head = F.max(F.when(big & (F.col("_rn") >= 1) & (F.col("_rn") <= reach), F.col("_rn"))).over(w)
    tail = F.min(F.when(big & (F.col("_rn") >= F.col("_n") - reach), F.col("_rn"))).over(w)
    s = s.withColumn("_head", F.coalesce(head, F.lit(0))).withColumn("_tail", F.coalesce(tail, F.col("_n")))
    return s.where((F.col("_n") <= 10) | ((F.col("_rn") >= F.col("_head")) & (F.col("_rn") < F.col("_tail")))).drop("_rn", "_n", "_gap", "_head", "_tail")


def remove_isolated(ids: DataFrame, by: list[str], value: str, size: int = 5, share: float = 0.4) -> DataFrame:
    """Sequences of ids without isolated ones. Each removal counts for the next id, so this is one pass a group."""
    kinds = {f.name: f.dataType.simpleString() for f in ids.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        return pdf[pdf[value].isin(drop_isolated(pdf[value].tolist(), size, share))]

    pruned = ids.select(*by, value)
    return pruned.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*by, value]))


def merge_holes(holes: DataFrame, by: list[str], threshold: int = 3) -> DataFrame:
    """Regions ``start_idx, end_idx`` (both included) at most ``threshold`` apart become one."""
    w = Window.partitionBy(*by).orderBy("start_idx", "end_idx")
    marked = holes.withColumn("_reach", F.max("end_idx").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = islands(marked, by, ["start_idx", "end_idx"], F.col("_reach").isNull() | (F.col("start_idx") - F.col("_reach") > threshold), "_run")
    return runs.groupBy(*by, "_run").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("_run")


def find_holes(ids: DataFrame, by: list[str], value: str, threshold: int = 3) -> DataFrame:
    """Runs of missing ids between the first and the last of each group, merged."""
    nexts = F.lead(value).over(Window.partitionBy(*by).orderBy(value))
    open_ = ids.select(*by, value).distinct().withColumn("_next", nexts).where(F.col("_next") - F.col(value) > 1)
    return merge_holes(open_.select(*by, (F.col(value) + 1).cast("long").alias("start_idx"), (F.col("_next") - 1).cast("long").alias("end_idx")), by, threshold)


def continue_words(tokens: DataFrame, marked: DataFrame) -> DataFrame:
    """The marked word starts and the tokens without a word id that follow them, up to the next word id."""
    flags = tokens.join(marked.select(BY, "ord", F.lit(True).alias("lis")), [BY, "ord"], "left")
    state = F.when(F.col("wid").isNotNull(), F.coalesce("lis", F.lit(False)))
    w = Window.partitionBy(BY).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return flags.withColumn("_on", F.last(state, ignorenulls=True).over(w)).where("_on").drop("_on")


def stitch_lis(tokens: DataFrame, drop_exits: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Stitched tokens and unaligned regions. ``drop_exits`` leaves out tokens flagged ``is_exit`` (the start that a window's end announces)."""
    if drop_exits and "is_exit" in tokens.columns:
        tokens = tokens.where(~F.col("is_exit"))
    tokens = with_order(tokens)
    marked = lis_words(tokens, **options)
    return continue_words(tokens, marked), find_holes(marked, [BY], "wid")


def dedupe_by_position(tokens: DataFrame) -> DataFrame:
    """The first token of every frame, in segment order."""
    w = Window.partitionBy(BY, "frame").orderBy("segment_index", "pos")
    return tokens.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def spoken_words(tokens: DataFrame, lower: bool = False) -> DataFrame:
    """Tokens of accepted segments with a word (else their symbol as text), empty ones left out."""
    kept = tokens.where(~F.col("rejected")) if "rejected" in tokens.columns else tokens
    word = F.coalesce("word", F.col("tk").cast("string")) if "word" in tokens.columns else F.col("tk").cast("string")
    return kept.withColumn("word", F.lower(word) if lower else word).where("word <> ''")


def edit_path(a: list[str], b: list[str], ins: float = 1.0, delete: float = 1.0, sub: float = 1.0) -> tuple[float, list[tuple]]:
    """Least cost of turning ``a`` into ``b`` (equal words, without case, are free) and the steps: op, place in a, place in b.

    Of equal costs a match goes before a substitution, a deletion and an insertion.
    """
    a, b = [w.lower() for w in a], [w.lower() for w in b]
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[w] for w in a], int), np.array([codes[w] for w in b], int)
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1))
    cost[0] = np.arange(m + 1) * ins
    ramp = np.arange(m + 1) * ins
    for i in range(1, n + 1):
        same = y == x[i - 1]
        row = np.concatenate([[i * delete], np.minimum(cost[i - 1, :-1] + sub, cost[i - 1, 1:] + delete)])
        row[1:][same] = cost[i - 1, :-1][same]
        if same.any():
            # Insertions chain up to the next match, whose cost is fixed.
            edges = np.concatenate([[0], np.flatnonzero(same) + 1, [m + 1]])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                row[s:e] = np.minimum.accumulate(row[s:e] - ramp[s:e]) + ramp[s:e]
        else:
            row = np.minimum.accumulate(row - ramp) + ramp
        cost[i] = row
    steps, i, j = [], n, m
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            steps.append(("match", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and j and np.isclose(cost[i, j], cost[i - 1, j - 1] + sub):
            steps.append(("sub", i - 1, j - 1))
            i, j = i - 1, j - 1
        elif i and np.isclose(cost[i, j], cost[i - 1, j] + delete):
            steps.append(("del", i - 1, None))
            i -= 1
        else:
            steps.append(("ins", None, j - 1))
            j -= 1
    return float(cost[n, m]), steps[::-1]


def diff_path(a: list[str], b: list[str]) -> tuple[float, list[tuple]]:
    """Similarity ratio and word-by-word steps of a Ratcliff-Obershelp comparison, without case."""
    a, b = [w.lower() for w in a], [w.lower() for w in b]
    matcher = difflib.SequenceMatcher(None, a, b)
    steps = []
    for op, s1, e1, s2, e2 in matcher.get_opcodes():
        both = min(e1 - s1, e2 - s2)
        steps += [(op, s1 + k, s2 + k) for k in range(both)]
        steps += [("delete", i, s2 + both if op == "delete" else e2) for i in range(s1 + both, e1)]
        steps += [("insert", s1, j) for j in range(s2 + both, e2)]
    return matcher.ratio(), steps


STEPS = "step int, op string, a_idx long, b_idx long, total double"


def _align(pairs: DataFrame, path) -> DataFrame:
    kinds = pairs.schema

    def run(batches):
        for pdf in batches:
            for key, a, b in zip(pdf[BY], pdf["a_words"], pdf["b_words"], strict=True):
                total, steps = path(list(a if a is not None else []), list(b if b is not None else []))
                out = pd.DataFrame([(k, *s, total) for k, s in enumerate(steps)], columns=["step", "op", "a_idx", "b_idx", "total"]).astype({"a_idx": "Int64", "b_idx": "Int64"})
                out.insert(0, BY, key)
                yield out

    return pairs.select(BY, "a_words", "b_words").mapInPandas(run, f"{BY} {kinds[BY].dataType.simpleString()}, {STEPS}")


def edit_alignment(pairs: DataFrame, ins: float = 1.0, delete: float = 1.0, sub: float = 1.0) -> DataFrame:
    """Steps of ``pairs(recording_id, a_words, b_words)``: op, a_idx, b_idx, and the distance as ``total``. Pairs without words have no step."""
    return _align(pairs, lambda a, b: edit_path(a, b, ins, delete, sub))


def diff_alignment(pairs: DataFrame) -> DataFrame:
    """As :func:`edit_alignment`, with equal, replace, insert and delete, and the ratio as ``total``."""
    return _align(pairs, diff_path)


def diff_statistics(steps: DataFrame) -> DataFrame:
    """Number of each operation, and the ratio."""
    n = lambda op: F.count_if(F.col("op") == op).alias(f"n_{op}")
    return steps.groupBy(BY).agg(n("equal"), n("replace"), n("insert"), n("delete"), F.max("total").alias("ratio"))


def transfer_timestamps(steps: DataFrame, spoken: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of spoken words at their reference words, and the regions without; substituted words have half the score.

    ``spoken(recording_id, idx, token_id, frame, score)``, ``reference(recording_id, idx, word)``.
    """
    used = steps.where(F.col("op").isin("match", "sub", "equal", "replace"))
    half = F.col("op").isin("sub", "replace")
    heard = spoken.select(BY, F.col("idx").cast("long").alias("a_idx"), "token_id", "frame", "score")
    meant = reference.select(BY, F.col("idx").cast("long").alias("b_idx"), "word")
    out = used.join(heard, [BY, "a_idx"]).join(meant, [BY, "b_idx"])
    out = out.select(BY, F.col("b_idx").alias("wid"), "word", "token_id", "frame", F.when(half, F.col("score") * 0.5).otherwise(F.col("score")).alias("score"), F.col("a_idx").alias("aligned_from"), half.alias("substitution"))
    return out, find_holes(out, [BY], "wid")


METHODS = {"lis": "lis", "edit_distance": "edit_distance", "levenshtein": "edit_distance", "diff": "diff", "gentle": "diff"}


def stitch(tokens: DataFrame, method: str = "lis", reference: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """Stitched tokens and holes, by method. Without reference words the last two remove repeated frames only; an unknown method raises ValueError."""
    if method not in METHODS:
        raise ValueError(f"no stitcher {method!r}; there are {sorted(METHODS)}")
    if METHODS[method] == "lis":
        return stitch_lis(tokens, **options)
    if reference is None:
        return dedupe_by_position(tokens), None
    spoken = with_order(spoken_words(tokens, METHODS[method] == "diff")).withColumnRenamed("ord", "idx")
    listed = lambda df, name: df.groupBy(BY).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias(name))
    pairs = listed(spoken, "a_words").join(listed(reference, "b_words"), BY)
    steps = edit_alignment(pairs, **options) if METHODS[method] == "edit_distance" else diff_alignment(pairs)
    return transfer_timestamps(steps, spoken, reference)


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals; 0 if both are empty."""
    meet = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0.0))
    union = (a_end - a_start) + (b_end - b_start) - meet
    return F.when(union > 0, meet / union).otherwise(0.0)
