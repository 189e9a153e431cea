from __future__ import annotations

import random
from itertools import groupby

import numpy as np
import pytest

from dnslens.operators.alerts import alerts, keep_after_gap
from dnslens.operators.ordered import newest_per_key, with_island, with_previous_max, with_rank
from dnslens.operators.windows import limit_events, page
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    seqs = sorted(rng.sample(range(-50, 4000), 600))
    return [(rng.choice(["hot", "hot", "hot", "b", None]), s, rng.choice("xyy"), rng.randrange(100)) for s in seqs]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq bigint, v string, n int").repartition(5)


def by_key(rows):
    keys = {r[0] for r in rows}
    return {k: [r for r in rows if r[0] == k] for k in keys}


@pytest.mark.parametrize("chunk", [1, 37, 10_000])
def test_rank(frame, rows, chunk):
    got = {r.seq: r["rank"] for r in with_rank(frame, ["key"], chunk_rows=chunk).collect()}
    assert got == {r[1]: i for part in by_key(rows).values() for i, r in enumerate(part, 1)}


@pytest.mark.parametrize("chunk", [1, 37, 10_000])
def test_island(frame, rows, chunk):
    want = {}
    for part in by_key(rows).values():
        for _, run in groupby(part, key=lambda r: r[2]):
            run = list(run)
            want.update({r[1]: run[0][1] for r in run})
    got = {r.seq: r.island for r in with_island(frame, ["key"], ["v"], chunk_rows=chunk).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 37, 10_000])
def test_previous_max(frame, rows, chunk):
    want = {}
    for part in by_key(rows).values():
        top = None
        for r in part:
            want[r[1]] = top
            top = r[3] if top is None else max(top, r[3])
    got = {r.seq: r.previous_max for r in with_previous_max(frame, ["key"], "n", chunk_rows=chunk).collect()}
    assert got == want


def test_newest_is_cut_before_the_shuffle(frame):
    plan = newest_per_key(frame, ["key"], 3, [F.col("seq").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_limits(frame, rows):
    assert limit_events(frame, 0).count() == len(rows)
    assert [r.seq for r in limit_events(frame, 3).collect()] == [r[1] for r in rows[:3]]
    for bad in (-1, 1.5, "3", True):
        with pytest.raises(ValueError):
            limit_events(frame, bad)
    older = [r[1] for r in rows if r[1] < 2000]
    assert [r.seq for r in page(frame, before=2000, rows=4).collect()] == older[::-1][:4]


# --- alert suppression -----------------------------------------------------------


def brute(rows, gap, scope):
    """Kept sequence numbers, stepping row by row."""
    kept, memory = [], {}
    order = sorted(rows, key=(lambda r: (r[1], r[0])) if scope == "domain" else (lambda r: r[0]))
    last_name, last_time = None, None
    for seq, ts, name in order:
        if scope == "domain":
            if name in memory and ts - memory[name] < gap:
                continue
            memory[name] = ts
        else:
            if name == last_name and ts - last_time < gap:
                continue
            last_name, last_time = name, ts
        kept.append(seq)
    return sorted(kept)


def test_keep_after_gap():
    rng = random.Random(1)
    for _ in range(200):
        times = np.array([rng.randrange(60) for _ in range(rng.randrange(1, 30))])
        gap = rng.randrange(1, 20)
        want, last = [], None
        for i, t in enumerate(times):
            if last is None or t - last >= gap:
                want.append(i)
                last = t
        assert keep_after_gap(times, gap) == want


@pytest.mark.parametrize("scope", ["domain", "arrival"])
@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_split_and_small_against_brute_force(spark, scope, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(500):
        ts = seq * 2 + rng.randrange(-30, 30) + 1000
        name = rng.choice(["hot.example"] * 12 + ["b.example", "c.example"]) if seq > 250 else "hot.example"
        rows.append((seq, ts, name))
    gap = 17
    df = spark.createDataFrame(rows, "seq bigint, s bigint, domain string").repartition(4)
    events = df.select(
        "seq", F.timestamp_seconds("s").alias("event_ts"), "domain", F.lit("high").alias("threat_level"),
        F.array(F.lit("r1"), F.lit("r2"), F.lit("r3")).alias("threat_reasons"),
    )
    want = brute(rows, gap, scope)
    for size in (1_000_000, 20):
        got = alerts(events, "17 seconds", scope, max_group_rows=size, chunk_rows=64).collect()
        assert sorted(r.seq for r in got) == want
        assert {r.message for r in got} == {"r1 • r2"}


def test_batches_continue_from_the_last_alert():
    import pandas as pd

    from dnslens.streaming.states import Suppression

    class State:
        """One key's variable, timers and clock."""

        def __init__(self, at=None):
            self.at, self.timers, self.now = at, [], 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            return None if self.at is None else (self.at,)

        def update(self, value):
            (self.at,) = value

        def clear(self):
            self.at = None

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return self.now

    def batch(state, frames):
        processor = Suppression(10_000_000, ["seq"])
        processor.init(state)
        return sorted(seq for out in processor.handleInputRows(("a",), iter(frames), state) for seq in out["seq"])

    frame = pd.DataFrame({"seq": [2, 1, 3, 4], "event_ts": pd.to_datetime([12, 5, 30, None], unit="s")})
    state = State(0)
    assert batch(state, [frame[:1], frame[1:]]) == [2, 3, 4] and state.at == 30_000_000 and not state.timers
    state = State(11_000_000)
    assert batch(state, [frame[:1]]) == [] and state.at == 11_000_000
    state = State()
    assert batch(state, [frame[3:]]) == [4] and state.at is None
    assert batch(state, [frame[:1]]) == [2] and state.timers == [22_001]
    assert batch(state, [frame[2:3]]) == [3] and state.timers == [22_001]  # one timer a name
    processor = Suppression(10_000_000, ["seq"])
    processor.init(state)
    state.now = 25_000
    assert not list(processor.handleExpiredTimer(("a",), state, None)) and state.at == 30_000_000 and state.timers[-1] == 40_001
    state.now = 40_001
    assert not list(processor.handleExpiredTimer(("a",), state, None)) and state.at is None


@pytest.mark.parametrize("operator", [lambda f: with_rank(f, ["key"]), lambda f: with_island(f, ["key"], ["v"]), lambda f: with_previous_max(f, ["key"], "n")])
def test_rows_are_exchanged_once(spark, frame, operator):
    """Window and join of the rows share one exchange; the other is that of the chunk summaries' keys."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = operator(frame)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(_k" in line]
    rows = [line for line in exchanges if "_chunk" in line]
    assert len(rows) <= 3, plan  # rows once; their summary (from the same partitioning) after its window


def test_alerts_without_times(spark):
    rows = [(i, None if i % 2 else f"2024-01-01 00:00:{i:02d}", "a.example", "high", ["r"]) for i in range(10)]
    frame = spark.createDataFrame(rows, "seq bigint, ts string, domain string, threat_level string, threat_reasons array<string>")
    frame = frame.withColumn("event_ts", F.col("ts").cast("timestamp"))
    for scope in ("domain", "arrival"):
        for limit in (1, 1000):
            got = sorted(r.seq for r in alerts(frame, "10 seconds", scope=scope, max_group_rows=limit).collect())
            assert got == [0, 1, 3, 5, 7, 9], (scope, limit)
    nothing = frame.filter("event_ts is null")
    assert alerts(nothing, "10 seconds").count() == alerts(nothing, "10 seconds", max_group_rows=1).count() == 5


def test_step_maps_compose():
    """Maps of slices, applied one after another, lead where following all times does."""
    import random

    import numpy as np

    from dnslens.operators.alerts import keep_after_gap, step_map

    rng = random.Random(8)
    for gap in (1, 7, 40, 1000):
        for _ in range(60):
            times = np.array(sorted(rng.sample(range(600), rng.randrange(1, 120))), np.int64)
            cuts = sorted({0, len(times), *(rng.randrange(len(times) + 1) for _ in range(4))})
            due, kept = -(1 << 40), []
            for low, high in zip(cuts, cuts[1:]):
                part = times[low:high]
                kept += [low + k for k in keep_after_gap(part, gap, due - gap)]
                entries, exits = step_map(part, gap)
                at = int(np.searchsorted(entries, due))
                due = int(exits[at]) if at < len(exits) else due
            assert kept == keep_after_gap(times, gap)
            assert due == times[kept[-1]] + gap


def test_slices_do_not_grow_with_a_small_limit(spark):
    """A small limit cuts a few slices a core, not one a row, and many names in a slice keep the right rows."""
    from dnslens.operators.alerts import MAX_GROUP_ROWS, slice_count

    assert slice_count(6_000_000, 1, 8) == 6_000_000 // MAX_GROUP_ROWS
    assert slice_count(1000, 1, 2) == 8 and slice_count(1000, 400, 2) == 3 and slice_count(0, 1, 2) == 1
    rng = random.Random(3)
    rows = [(seq, rng.randrange(100), rng.choice(["hot.example", f"name{rng.randrange(300)}.example"])) for seq in range(1500)]
    df = spark.createDataFrame(rows, "seq bigint, s bigint, domain string")
    events = df.select("seq", F.timestamp_seconds("s").alias("event_ts"), "domain", F.lit("high").alias("threat_level"),
                       F.array(F.lit("r1")).alias("threat_reasons"))
    got = alerts(events, "17 seconds", max_group_rows=1).collect()
    assert sorted(r.seq for r in got) == brute(rows, 17, "domain")
