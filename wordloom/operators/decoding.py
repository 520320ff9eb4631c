"""Decoding graphs as arc tables, frame-synchronous Viterbi search, and segment rejection.

Token c of a transcript (numbered over all its words) has the non-blank state 2c + 1 and the blank
state 2c + 2. State 0 is the start, 2N + 1 the final blank state and 2N + 2 the end. Label 0 is the
blank. An arc with a label from 0 takes one frame; ``aux`` is the symbol that it puts out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.helpers import let

#: Default scores of leaving the expected path.
SKIP_PENALTY, RETURN_PENALTY = -0.5, -18.0


def token_table(words: DataFrame, by: str = "doc_id", unknown: int | None = None) -> DataFrame:
    """``words(by, idx, ids)`` as one row a token: ``by, c, wid, id, is_first, is_last, n``. A word without ids takes ``unknown``."""
    ids = F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(unknown).cast("int")) if unknown is not None else F.col("ids"))
    spread = words.select(by, F.col("idx").alias("wid"), F.size(ids).alias("_k"), F.posexplode(ids).alias("_p", "id"))
    w = Window.partitionBy(by)
    out = spread.withColumn("c", F.row_number().over(w.orderBy("wid", "_p")) - 1).withColumn("n", F.count("*").over(w).cast("int"))
    return out.select(by, "c", "wid", "id", (F.col("_p") == 0).alias("is_first"), (F.col("_p") == F.col("_k") - 1).alias("is_last"), "n")


def factor_arcs(tokens: DataFrame, by: str = "doc_id", blank_penalty: float = 0.0, skip_penalty: float | None = SKIP_PENALTY, return_penalty: float | None = RETURN_PENALTY, bonus: float = 0.0) -> DataFrame:
    """Arcs ``by, src, dst, label, aux, score`` of the graph that lets a window begin and end at any word.

    A window enters at the first token of a word, leaves after the last one (putting out the next
    token's symbol), may skip tokens inside a word and may go back to the start.
    """
    w = Window.partitionBy(by).orderBy("c")
    t = tokens.withColumn("before", F.lag("id").over(w)).withColumn("before_word", F.lag("wid").over(w)).withColumn("last_word", F.max("wid").over(Window.partitionBy(by)))
    c, n, here, blank = F.col("c"), F.col("n"), 2 * F.col("c") + 1, 2 * F.col("c") + 2
    final, skip_id, return_id = 2 * n + 1, 2 * n + 1, 2 * n + 2
    bp, bo = F.lit(float(blank_penalty)), F.lit(float(bonus))

    def arc(when: Column, src, dst, label, aux, score) -> Column:
        return F.when(when, F.struct(F.lit(src).cast("int").alias("src") if not isinstance(src, Column) else src.cast("int").alias("src"), dst.cast("int").alias("dst"), (F.lit(label) if not isinstance(label, Column) else label).cast("int").alias("label"), (F.lit(aux) if not isinstance(aux, Column) else aux).cast("int").alias("aux"), score.cast("double").alias("score")))

    always, zero = F.lit(True), F.lit(0)
    arcs = [
        arc((c > 0) & (F.col("id") != F.col("before")), here - 2, here, F.col("id"), c + 1, bo),
        arc(c > 0, here - 1, here, F.col("id"), c + 1, bo),
        arc(always, here, here, F.col("id"), 0, bo), arc(always, here, blank, 0, 0, bp), arc(always, blank, blank, 0, 0, bp),
        arc(F.col("is_first"), zero, here, F.col("id"), c + 1, bo),
        arc(F.col("is_last") & (c < n - 1), here, final, 0, c + 2, bp), arc(F.col("is_last") & (c < n - 1), here, final, F.col("id"), c + 2, bo),
        arc(c == n - 1, blank, final, 0, n + 1, bp),
        arc(c == 0, zero, zero, 0, 0, bp), arc(c == 0, final, final, 0, 0, bp), arc(c == 0, final, final + 1, -1, -1, F.lit(0.0)),
    ]
    if return_penalty is not None:
        arcs.append(arc(F.col("is_last"), here, zero, 0, return_id, F.lit(return_penalty)))
    if skip_penalty is not None:
        inside = (F.col("before_word") == F.col("wid")) & ~((F.col("wid") == F.col("last_word")) & (c == n - 1))
        arcs.append(arc(inside, blank - 2, blank, 0, skip_id, F.lit(skip_penalty)))
    spread = t.select(by, F.explode(F.filter(F.array(*arcs), lambda a: a.isNotNull())).alias("arc"))
    return spread.select(by, "arc.*")


def symbols(tokens: DataFrame, by: str = "doc_id") -> DataFrame:
    """``by, aux, wid, tk``: the word that a symbol opens (first tokens only, and the end as one word more), and its token id."""
    own = tokens.select(by, (F.col("c") + 1).alias("aux"), F.when(F.col("is_first"), F.col("wid")).cast("long").alias("wid"), F.col("id").alias("tk"))
    ends = tokens.groupBy(by).agg((F.max("n") + 1).alias("aux"), (F.max("wid") + 1).cast("long").alias("wid")).withColumn("tk", F.lit(None).cast("int"))
    return own.unionByName(ends)


def ctc_arcs(tokens: DataFrame, by: str = "doc_id") -> DataFrame:
    """Arcs of the plain CTC topology: every token in order, blanks between, and none left out."""
    w = Window.partitionBy(by).orderBy("c")
    t = tokens.withColumn("before", F.lag("id").over(w))
    c, n, here, blank = F.col("c"), F.col("n"), 2 * F.col("c") + 1, 2 * F.col("c") + 2
    pack = lambda src, dst, label, aux: F.struct(src.cast("int").alias("src"), dst.cast("int").alias("dst"), label.cast("int").alias("label"), aux.cast("int").alias("aux"), F.lit(0.0).alias("score"))
    zero = F.lit(0)
    arcs = F.array(
        F.when(c == 0, pack(zero, zero, zero, zero)), F.when(c == 0, pack(zero, here, F.col("id"), c + 1)),
        F.when((c > 0) & (F.col("id") != F.col("before")), pack(here - 2, here, F.col("id"), c + 1)), F.when(c > 0, pack(here - 1, here, F.col("id"), c + 1)),
        pack(here, here, F.col("id"), zero), pack(here, blank, zero, zero), pack(blank, blank, zero, zero),
        F.when(c == n - 1, pack(here, 2 * n + 1, F.lit(-1), F.lit(-1))), F.when(c == n - 1, pack(blank, 2 * n + 1, F.lit(-1), F.lit(-1))),
    )
    return t.select(by, F.explode(F.filter(arcs, lambda a: a.isNotNull())).alias("arc")).select(by, "arc.*")


def _ties(score: np.ndarray, best) -> np.ndarray:
    """Scores that differ from the best by no more than rounding, as sums of the same terms in another order do."""
    return score >= best - 1e-9 * (1 + np.abs(best))


def viterbi(logp: np.ndarray, arcs: np.ndarray, beam: float = 20.0) -> tuple[list[int], float] | None:
    """The best path's arcs, one a frame, and its score; None if no path ends. ``arcs``: src, dst, label, aux, score.

    Of paths with equal scores, up to rounding, the one that opens more tokens is taken, then the one by the earlier arc.
    """
    src, dst, label = arcs[:, 0].astype(int), arcs[:, 1].astype(int), arcs[:, 2].astype(int)
    score = arcs[:, 4]
    states = int(max(src.max(), dst.max())) + 1
    walk = np.flatnonzero(label >= 0)
    ends = np.flatnonzero(label < 0)
    order = walk[np.argsort(dst[walk], kind="stable")]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(dst[order]) > 0]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    at = np.full(states, -np.inf)
    at[0] = 0.0
    # Tokens and the end that each arc announces, and that each state's path has: skips and returns have higher symbols.
    opens = ((arcs[order, 3] > 0) & (arcs[order, 3] <= (states - 1) // 2)).astype(np.int64)
    opened = np.zeros(states, np.int64)
    back = np.full((len(logp), states), -1, np.int32)
    for t, frame in enumerate(logp):
        got = at[src[order]] + score[order] + frame[label[order]]
        best = np.maximum.reduceat(got, begin)
        tied = _ties(got, best[group])
        so_far = np.where(tied, opened[src[order]] + opens, -1)
        most = np.maximum.reduceat(so_far, begin)
        pick = np.full(len(begin), len(order))
        np.minimum.at(pick, group, np.where(tied & (so_far == most[group]), np.arange(len(order)), len(order)))
        at = np.full(states, -np.inf)
        at[dst[order[begin]]] = best
        opened = np.zeros(states, np.int64)
        opened[dst[order[begin]]] = most
        at[at < at.max() - beam] = -np.inf
        back[t, dst[order[begin]]] = order[np.minimum(pick, len(order) - 1)]
    closing = at[src[ends]] + score[ends]
    if not len(ends) or not np.isfinite(closing.max()):
        return None
    k = ends[int(_ties(closing, closing.max()).argmax())]
    state, path = src[k], []
    for t in range(len(logp) - 1, -1, -1):
        path.append(int(back[t, state]))
        state = src[path[-1]]
    return path[::-1], float(closing.max())


PATHS = "frame int, label int, aux int, score double"


def decode_segments(segments: DataFrame, graph: DataFrame, by: str = "doc_id", beam: float = 20.0) -> DataFrame:
    """Best paths of ``segments(by, segment_index, logp array<array<double>>)``: a row a frame with label, aux and score.

    ``graph(by, arcs array<array<double>>)`` is joined on ``by``; segments are decoded one by one, and
    those without a path give no row.
    """
    kind = segments.schema[by].dataType.simpleString()
    joined = segments.join(graph, by)

    def run(batches):
        for pdf in batches:
            for key, segment, logp, arcs in zip(pdf[by], pdf["segment_index"], pdf["logp"], pdf["arcs"], strict=True):
                arcs, logp = np.stack([np.asarray(a, float) for a in arcs]), np.stack([np.asarray(x, float) for x in logp])
                found = viterbi(logp, arcs, beam)
                if found is None:
                    continue
                path = arcs[found[0]]
                frames = np.arange(len(path))
                yield pd.DataFrame({by: key, "segment_index": segment, "frame": frames, "label": path[:, 2].astype(int), "aux": path[:, 3].astype(int), "score": path[:, 4] + logp[frames, path[:, 2].astype(int)]})

    return joined.select(by, "segment_index", "logp", "arcs").mapInPandas(run, f"{by} {kind}, segment_index int, {PATHS}")


def graph_arrays(arcs: DataFrame, by: str = "doc_id") -> DataFrame:
    """The arcs of each graph in one array, for decoding."""
    row = F.array(*[F.col(c).cast("double") for c in ("src", "dst", "label", "aux", "score")])
    return arcs.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "label", "aux", row.alias("row")))), lambda x: x["row"]).alias("arcs"))


def path_tokens(paths: DataFrame, sizes: DataFrame, by: str = "doc_id") -> DataFrame:
    """Tokens of paths: ``by, segment_index, pos, frame, aux, score, is_exit``.

    A symbol opens a token at its frame. Its score is the mean of the frame's own score and those of the
    skip and return arcs up to the next symbol; other frames don't count. ``sizes(by, n)`` gives the
    number of tokens of each transcript. ``is_exit`` marks the start that a window's end announces.
    """
    w = Window.partitionBy(by, "segment_index").orderBy("frame")
    p = paths.join(sizes, by).where("aux > 0").withColumn("token", F.col("aux") <= F.col("n") + 1)
    p = p.withColumn("pos", F.sum(F.col("token").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = p.where("pos >= 0").groupBy(by, "segment_index", "pos").agg(F.min("frame").alias("frame"), F.min_by("aux", "frame").alias("aux"), F.avg("score").alias("score"))
    last = Window.partitionBy(by, "segment_index")
    return out.withColumn("is_exit", F.col("pos") == F.max("pos").over(last))


def segment_decisions(paths: DataFrame, sizes: DataFrame, by: str = "doc_id", least: float = 0.5, skips: float = 0.2, returns: int = 3) -> DataFrame:
    """``by, segment_index, frame_score, skip_share, n_returns, rejected`` by the three rules: mean frame score under ln(least), too many skips, too many returns."""
    p = paths.join(sizes, by)
    n_skip, n_return, hyps = (F.count_if(x) for x in (F.col("aux") == 2 * F.col("n") + 1, F.col("aux") > 2 * F.col("n") + 1, F.col("aux") > 0))
    out = p.groupBy(by, "segment_index").agg((F.sum("score") / F.count("*")).alias("frame_score"), (n_skip / F.greatest(hyps, F.lit(1))).alias("skip_share"), n_return.cast("int").alias("n_returns"))
    return out.withColumn("rejected", (F.col("frame_score") < float(np.log(least))) | (F.col("skip_share") > skips) | (F.col("n_returns") >= returns))


def attach_symbols(tokens: DataFrame, names: DataFrame, offsets: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """Adds word ids and token symbols, and with ``offsets(by, segment_index, frame_offset)`` moves frames to the recording."""
    out = tokens.join(names, [by, "aux"], "left").withColumn("token_id", F.col("aux"))
    if offsets is not None:
        out = out.join(offsets, [by, "segment_index"]).withColumn("frame", F.col("frame") + F.col("frame_offset")).drop("frame_offset")
    return out


def best_token_scores(x: Column) -> Column:
    """Greatest log-probability of a frame."""
    return let(x, F.array_max)
