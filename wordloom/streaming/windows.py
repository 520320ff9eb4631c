"""Streams of samples and tokens: sliding windows with late data, sessions by silence, and stitching state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(events: DataFrame, ts: str = "ts", size: str = "15 seconds", step: str = "13 seconds", late: str = "1 minute", by: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """Count, and with ``value`` its sum, of every overlapping window. Works on batches and streams; a stream waits ``late`` for stragglers."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    extra = [F.sum(value).alias("total")] if value else []
    out = rows.groupBy(F.window(ts, size, step), *by).agg(F.count("*").alias("n"), *extra)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", *[c for c in ("total",) if value])


def sessions(events: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """Runs of events of a key without a pause of ``gap``: start, end, count."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Piles:
    """Patience sorting that goes on: a longest strictly increasing sequence of words, with only the tokens that can still be part of one."""

    def __init__(self, held: list[int]):
        """``held`` is the flat state: number of tokens, of each order, word, frame and predecessor; then the pile tops."""
        n = held[0] if held else 0
        self.rows = [tuple(held[1 + 4 * i : 5 + 4 * i]) for i in range(n)]
        self.tops = list(held[1 + 4 * n :])
        self.tails = [self.rows[i][1] for i in self.tops]

    def take(self, order: int, word: int, frame: int) -> None:
        k = bisect_left(self.tails, word)
        if k == len(self.tops):
            self.tails.append(word)
            self.tops.append(0)
        self.tails[k], self.tops[k] = word, len(self.rows)
        self.rows.append((order, word, frame, self.tops[k - 1] if k else -1))

    def longest(self) -> list[tuple[int, int, int, int]]:
        out, i = [], self.tops[-1] if self.tops else -1
        while i >= 0:
            out.append(self.rows[i])
            i = self.rows[i][3]
        return out[::-1]

    def state(self) -> list[int]:
        """The tokens that some pile top leads back to, renumbered."""
        kept: set[int] = set()
        for i in self.tops:
            while i >= 0 and i not in kept:
                kept.add(i)
                i = self.rows[i][3]
        order = sorted(kept)
        new = {i: j for j, i in enumerate(order)} | {-1: -1}
        return [len(order), *(x for i in order for x in (*self.rows[i][:3], new[self.rows[i][3]])), *(new[i] for i in self.tops)]


def stitch_stream(tokens: DataFrame, ts: str = "ts", late: str = "1 minute", timeout: str = "1 minute") -> DataFrame:
    """Words of a stream of tokens ``recording_id, ord, wid, frame, last boolean, ts``: ``recording_id, pos, wid, frame, final``.

    A recording's tokens come in ascending ``ord``; one that is behind what was taken before is late and
    ignored. State is kept for the tokens that may still be part of the longest increasing word sequence.
    Every batch emits that sequence from its first changed position on; a later row of a position
    replaces an earlier one, and positions beyond the last row of a batch are gone. Once a token with
    ``last`` has come, or the watermark of ``ts`` has passed the recording's latest token by ``timeout``,
    the whole sequence is emitted as final and the state goes.
    """
    wait = pd.Timedelta(timeout) // pd.Timedelta("1ms")

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sent, high, seen = state.get if state.exists else ([], [], -(1 << 62), 0)
        piles, done = Piles(held), state.hasTimedOut
        rows = []
        for pdf in batches:
            rows += [tuple(map(int, r)) for r in pdf.loc[pdf["wid"].notna(), ["ord", "wid", "frame"]].itertuples(index=False)]
            done |= bool(pdf["last"].any())
            if len(pdf):
                seen = max(seen, int(pdf["_ms"].max()))
        for order, word, frame in sorted(r for r in rows if r[0] > high):
            piles.take(order, word, frame)
            high = order
        found = piles.longest()
        same = 0
        while same < min(len(found), len(sent)) and found[same][0] == sent[same]:
            same += 1
        if done:
            same = 0
            state.remove()
        else:
            state.update((piles.state(), [r[0] for r in found], high, seen))
            state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"recording_id": key[0], "pos": range(same, len(found)), "wid": [r[1] for r in found[same:]], "frame": [r[2] for r in found[same:]], "final": done})

    rows = tokens.withWatermark(ts, late).withColumn("_ms", F.unix_millis(ts))
    return rows.groupBy("recording_id").applyInPandasWithState(run, "recording_id long, pos long, wid long, frame long, final boolean", "held array<long>, sent array<long>, high long, seen long", "append", GroupStateTimeout.EventTimeTimeout)
