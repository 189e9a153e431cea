"""State per key on streams: alert suppression, the activity feed and zero-filled traffic.

Each key has a few state variables of its own and, where it can be forgotten, one timer. Spark keeps them in its
key-value store, so a micro-batch touches only the keys that it has rows or due timers for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dnslens.operators.alerts import keep_after_gap

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_key_store(spark: SparkSession) -> None:
    """Let the session's streams keep their state in the store that state variables and timers need."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def transform(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, timed: bool) -> DataFrame:
    """``processor`` over the rows of each key."""
    with_key_store(rows.sparkSession)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime" if timed else "None")


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class Suppression(StatefulProcessor):
    """Drops what comes within ``gap`` microseconds of a name's last alert.

    The state of a name is the time of its last alert, with a timer for the moment from which it can suppress
    nothing any more; rows without a time all pass. The rows of one name in a micro-batch are sorted in memory.
    """

    def __init__(self, gap: int, columns: list[str]) -> None:
        self._gap, self._columns = gap, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = []
        for frame in rows:
            untimed = frame["event_ts"].isna()
            if untimed.any():
                yield frame.loc[untimed, self._columns]
            frames.append(frame[~untimed])
        batch = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)
        if not len(batch):
            return
        times = _micros(batch["event_ts"])
        order = np.lexsort((batch["seq"].to_numpy(), times))
        state = self._last.get()
        kept = order[keep_after_gap(times[order], self._gap, None if state is None else state[0])]
        if len(kept):
            last = int(times[kept[-1]])
            self._last.update((last,))
            if state is None:
                self._handle.registerTimer(self._due(last))
            yield batch.loc[kept, self._columns]

    def _due(self, last: int) -> int:
        return (last + self._gap) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._last.get()
        due = None if state is None else self._due(state[0])
        if due is not None and due > timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(due)  # another alert came after the timer was set
        elif state is not None:
            self._last.clear()
        return iter(())

    def close(self) -> None:
        pass


class BucketSuppression(StatefulProcessor):
    """``Suppression`` for many names: one state, and one timer, for all names of a bucket.

    A call and its reads of the state cost about as much for a bucket as for a name, so streams in which most names come once go by
    buckets. The state has the last alert of every name that can still suppress something; it is read and written whole for a
    bucket that has rows. The rows of one bucket in a micro-batch are sorted in memory.
    """

    def __init__(self, gap: int, columns: list[str]) -> None:
        self._gap, self._columns = gap, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("last", "names array<string>, at array<bigint>, timer bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = []
        for frame in rows:
            untimed = frame["event_ts"].isna()
            if untimed.any():
                yield frame.loc[untimed, self._columns]
            frames.append(frame[~untimed])
        batch = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0].reset_index(drop=True)
        if not len(batch):
            return
        times = _micros(batch["event_ts"])
        codes, names = pd.factorize(batch["domain"], use_na_sentinel=False)
        order = np.lexsort((batch["seq"].to_numpy(), times, codes))
        times, ends = times[order], np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        last, timer = self._read()
        kept, start = [], 0
        for name, end in zip(names, ends):
            name = None if pd.isna(name) else name
            found = keep_after_gap(times[start:end], self._gap, last.get(name))
            if found:
                last[name] = int(times[start + found[-1]])
                kept.extend(start + at for at in found)
            start = end
        if kept:
            self._write(last, timer, timerValues.getCurrentWatermarkInMs())
            yield batch.loc[order[kept], self._columns]

    def _read(self) -> tuple[dict, int | None]:
        state = self._state.get()
        return ({}, None) if state is None else (dict(zip(state[0], state[1], strict=True)), state[2])

    def _due(self, last: int) -> int:
        return (last + self._gap) // 1000 + 1

    def _write(self, last: dict, timer: int | None, now: int) -> None:
        """Keep the names that are not due yet, and a timer for the last of them."""
        last = {name: at for name, at in last.items() if self._due(at) > now}
        if not last:
            self._state.clear()
            return
        if timer is None or timer <= now:
            timer = self._due(max(last.values()))
            self._handle.registerTimer(timer)
        self._state.update((list(last), list(last.values()), timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, timer = self._read()
        self._write(last, timer, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class Feed(StatefulProcessor):
    """The activity feed of a session: numbered events thinned out, equal neighbours folded.

    The state is the number of events so far and the run that is still open. Rows: kind, seq, event_ts, level,
    message; only every event whose number is ``first``, or a multiple of ``every``, becomes an entry. Emits the runs that a
    micro-batch began or went on with (update mode). The rows of one session in a micro-batch are sorted in memory.
    """

    COLUMNS = ("session_id", "first_seq", "level", "message", "event_ts", "entries")

    def __init__(self, first: tuple[int, ...], every: int) -> None:
        self._first, self._every = first, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "events bigint")
        self._run = handle.getValueState("run", "first_seq bigint, level string, message string, entries bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", ignore_index=True)
        state = self._seen.get()
        before = 0 if state is None else state[0]
        event = (batch["kind"] == "event").to_numpy()
        rank = before + np.cumsum(event)
        due = ~event | np.isin(rank, self._first) | (rank % self._every == 0)
        entries = batch[due & (batch["message"].fillna("") != "").to_numpy()]
        self._seen.update((before + int(event.sum()),))
        if not len(entries):
            return
        level, message = entries["level"].to_numpy(), entries["message"].to_numpy()
        new = np.ones(len(entries), bool)
        new[1:] = (level[1:] != level[:-1]) | (message[1:] != message[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(entries))
        seq, times = entries["seq"].to_numpy(), entries["event_ts"]
        open_ = self._run.get()
        out = []
        for number, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
            first, count = int(seq[start]), end - start
            if number == 0 and open_ is not None and (open_[1], open_[2]) == (level[start], message[start]):
                first, count = open_[0], open_[3] + count
            out.append((key[0], first, level[start], message[start], times.iloc[end - 1], count))
        last = out[-1]
        self._run.update((int(last[1]), last[2], last[3], int(last[5])))
        yield pd.DataFrame(out, columns=list(self.COLUMNS))

    def close(self) -> None:
        pass


class ZeroFill(StatefulProcessor):
    """Buckets in a row, idle ones with 0, up to the watermark.

    Input: closed buckets that have events (``at``: a moment in the bucket, ``events``). The state is the end of the last
    bucket told; a timer for the end of the next one tells idle buckets as the watermark passes them, even while nothing comes.
    """

    COLUMNS = ("bucket_start", "events")

    def __init__(self, step: int) -> None:
        self._step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._end = handle.getValueState("end", "at bigint")

    def _frame(self, starts: np.ndarray, events: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"bucket_start": starts.astype("datetime64[us]"), "events": events})

    def _told(self, end: int) -> None:
        self._end.update((end,))
        self._handle.registerTimer((end + self._step) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        starts = _micros(batch["at"]) // self._step * self._step
        order = np.argsort(starts)
        starts, events = starts[order], batch["events"].to_numpy()[order]
        state = self._end.get()
        if state is not None:
            keep = starts >= state[0]
            starts, events = starts[keep], events[keep]
        if not len(starts):
            return
        grid = np.arange(starts[0] if state is None else state[0], starts[-1] + 1, self._step)
        counts = np.zeros(len(grid), np.int64)
        counts[(starts - grid[0]) // self._step] = events
        self._told(int(starts[-1]) + self._step)
        yield self._frame(grid, counts)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._end.get()
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self._step * self._step
        if state is None or passed <= state[0]:
            return iter(())
        grid = np.arange(state[0], passed, self._step)
        self._told(passed)
        return iter([self._frame(grid, np.zeros(len(grid), np.int64))])

    def close(self) -> None:
        pass
