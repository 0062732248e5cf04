"""Refreshes with timers: a changed thing is read again once it is quiet, but not too often, and not before it has settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Output of `refreshes`; times are in milliseconds.
REFRESH = "key string, at_ms long, first_ms long, last_ms long, changes long, deferred boolean"
#: What is kept of a key: the pending changes' first and last time and number, and the last refresh (-1: none).
HELD = "first_ms long, last_ms long, changes long, refreshed_ms long"


def due(first: int, last: int, refreshed: int, settle: int, most: int, gap: int) -> tuple[int, bool]:
    """When pending changes are to be read, and whether the gap to the last refresh puts that off.

    Changes settle `settle` ms after the last, but at most `most` ms after the first; a refresh is `gap` ms after the one before.
    """
    settled = min(last + settle, first + most)
    return (settled, False) if refreshed < 0 else (max(settled, refreshed + gap), refreshed + gap > settled)


def step(held: tuple[int, int, int, int], times: list[int], now: int, settle: int, most: int, gap: int) -> tuple[tuple[int, int, int, int], list[tuple]]:
    """The state after sorted change times and then the time `now`, and the refreshes due meanwhile."""
    first, last, changes, refreshed = held
    out = []

    def run_until(t: int) -> None:
        nonlocal first, last, changes, refreshed
        if changes:
            at, deferred = due(first, last, refreshed, settle, most, gap)
            if at <= t:
                out.append((at, first, last, changes, deferred))
                first, last, changes, refreshed = -1, -1, 0, at

    for t in times:
        run_until(t - 1)
        first, last, changes = (t if not changes else min(first, t)), max(last, t), changes + 1
    run_until(now)
    return (first, last, changes, refreshed), out


def refreshes(changes: DataFrame, key: str, at: str, settle_ms: int, most_ms: int, gap_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, at_ms, first_ms, last_ms, changes, deferred) of a stream of changes (key, at): when each key is to be read again.

    Each key has its own timer in event time: it fires when the watermark (`late` behind the newest change of any key) passes the time that is
    due. Pending changes are four numbers a key, however many they are, so a hot key is no large state. Changes behind the
    watermark are handled when they come, as changes of the watermark's time. A micro-batch that is tried again gives the same.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-1, -1, 0, -1)
        mark = state.getCurrentWatermarkMs()
        times = [] if state.hasTimedOut else sorted(max(t, mark) for f in frames for t in (f["_at"].astype("datetime64[ms]").astype("int64")).tolist())
        held, out = step(held, times, mark, settle_ms, most_ms, gap_ms)
        state.update(held)
        if held[2]:
            state.setTimeoutTimestamp(max(due(held[0], held[1], held[3], settle_ms, most_ms, gap_ms)[0], mark + 1))
        yield pd.DataFrame([(str(group[0]), *r) for r in out], columns=["key", "at_ms", "first_ms", "last_ms", "changes", "deferred"])

    rows = changes.selectExpr(f"CAST(`{key}` AS string) AS _key", f"CAST(`{at}` AS timestamp) AS _at").where("_key IS NOT NULL AND _at IS NOT NULL")
    return rows.withWatermark("_at", late).groupBy("_key").applyInPandasWithState(run, REFRESH, HELD, "append", GroupStateTimeout.EventTimeTimeout)
