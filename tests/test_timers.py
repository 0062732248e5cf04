"""Timers of refreshes against a clock that ticks, and a stream in several batches against one pass."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st

from loomfield.plans import registry
from loomfield.streaming import timers


def ticking(times, end, settle, most, gap):
    """Looks at a clock every millisecond."""
    out, first, last, n, refreshed = [], None, None, 0, None
    for now in range(end + 1):
        for _ in range(times.count(now)):
            first, last, n = now if first is None else first, now, n + 1
        if n and now >= min(last + settle, first + most) and (refreshed is None or now >= refreshed + gap):
            out.append((now, first, last, n))
            first, last, n, refreshed = None, None, 0, now
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=12), st.integers(1, 9), st.integers(1, 20), st.integers(1, 30), st.lists(st.integers(0, 60), max_size=3))
def test_steps_are_a_ticking_clock(times, settle, most, gap, stops):
    held, out = (-1, -1, 0, -1), []
    for a, b in zip([-1, *sorted(stops)], [*sorted(stops), 120], strict=True):
        held, more = timers.step(held, sorted(t for t in times if a < t <= b), b, settle, most, gap)
        out += more
    assert [r[:4] for r in out] == ticking(sorted(times), 120, settle, most, gap)


def test_stream_in_batches(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    all_rows = []
    for n in range(4):
        rows = [(f"k{rng.randrange(5)}", start + timedelta(seconds=60 * n + rng.randrange(60))) for _ in range(30)] + [(None, start), ("k0", None)]
        all_rows += rows
        spark.createDataFrame(rows, "path string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = timers.refreshes(stream, "path", "at", 5_000, 20_000, 30_000, "1 minute")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(90)
    got = defaultdict(list)
    for r in spark.read.schema(timers.REFRESH).parquet(f"{tmp_path}/out").collect():
        got[r.key].append((r.at_ms, r.first_ms, r.last_ms, r.changes))
    times = defaultdict(list)
    for k, t in all_rows:
        if k and t:
            times[k].append(int(t.timestamp() * 1000))
    end = max(max(t) for t in times.values()) - 60_000
    for k, own in times.items():
        want = [r[:4] for r in timers.step((-1, -1, 0, -1), sorted(own), 10**15, 5_000, 20_000, 30_000)[1] if r[0] <= end]
        assert sorted(got[k])[: len(want)] == want
    assert sum(map(len, got.values())) > 5


def test_query(spark):
    out = registry.QUERIES["t05_refreshes"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) > 10 and {r.deferred for r in out} == {True, False} and all(r.at_ms > r.last_ms - 1 for r in out)
