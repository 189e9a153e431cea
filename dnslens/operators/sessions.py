"""Session statistics, activity, ledger and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens import dims
from dnslens.functions.text import fill, non_empty, strip
from dnslens.operators.ordered import newest_per_key, with_island, with_rank

SESSION_DIMENSIONS = ("domain", "record_type", "source_ip", "transport", "rcode")
REPORT_SIZES = {"domain": 5, "record_type": 5, "source_ip": 5, "rcode": 5, "transport": 10}
#: Events of a session that leave a note: the first of these numbers, and every so manieth.
SAMPLED_FIRST, SAMPLED_EVERY = (1, 5), 25
FEED_SCHEMA = "session_id string, first_seq bigint, level string, message string, event_ts timestamp, entries bigint"


# --- statistics ----------------------------------------------------------------


def session_stats(df: DataFrame) -> DataFrame:
    """Counts per dimension value and the total, over everything seen.

    Unlike the summary, unknown values count. One pass by grouping sets; the
    total has dimension ``total`` and no value.
    """
    sets = [[name] for name in SESSION_DIMENSIONS] + [[]]
    cols = [F.col(name) for name in SESSION_DIMENSIONS]
    grouped = df.groupingSets([[F.col(name) for name in group] for group in sets], *cols).agg(
        F.count("*").alias("events"),
        F.min("seq").alias("first_seq"),
        *[F.grouping(name).alias("_g_" + name) for name in SESSION_DIMENSIONS],
    )
    dimension = F.coalesce(
        *[F.when(F.col("_g_" + name) == 0, F.lit(name)) for name in SESSION_DIMENSIONS], F.lit("total")
    )
    value = F.coalesce(*[F.when(F.col("_g_" + name) == 0, F.col(name)) for name in SESSION_DIMENSIONS])
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "events", "first_seq")


def session_report(df: DataFrame) -> DataFrame:
    """Total and top values per dimension; ties go to the value seen first; empty without events.

    Columns ``dimension``, ``rank``, ``value``, ``events``.
    """
    stats = session_stats(df).filter(F.col("events") > 0)
    order = [F.col("events").desc(), F.col("first_seq").asc()]
    # cut to the longest list before the shuffle, then to each dimension's own length
    longest = newest_per_key(stats, ["dimension"], max(REPORT_SIZES.values()), order)
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(*order))
    size = F.coalesce(
        *[F.when(F.col("dimension") == name, F.lit(k)) for name, k in REPORT_SIZES.items()], F.lit(1)
    )
    ranked = longest.withColumn("rank", rank).filter(F.col("rank") <= size)
    return ranked.select("dimension", "rank", "value", "events")


# --- activity --------------------------------------------------------------------


def activity_sample(df: DataFrame, chunk_rows: int = dims.CHUNK_ROWS) -> DataFrame:
    """Notes for the 1st, 5th and every 25th event of a session."""
    ranked = with_rank(df, ["session_id"], chunk_rows=chunk_rows)
    due = F.col("rank").isin(*SAMPLED_FIRST) | (F.col("rank") % SAMPLED_EVERY == 0)
    note = fill(dims.NOTE_OBSERVED, F.col("record_type"), F.col("domain"))
    return ranked.filter(due).select(
        "session_id", "seq", "event_ts", "rank", F.lit("info").alias("level"), note.alias("message")
    )


def collapse_activity(activity: DataFrame, chunk_rows: int = dims.CHUNK_ROWS) -> DataFrame:
    """Fold consecutive activities of a session with equal message and level.

    One row stays per run, with the timestamp of its last entry; empty messages are
    ignored. Needs ``session_id``, ``seq``, ``event_ts``, ``level`` and ``message``.
    """
    kept = activity.filter(non_empty(F.col("message")).isNotNull())
    runs = with_island(kept, ["session_id"], ["level", "message"], island="first_seq", chunk_rows=chunk_rows)
    return runs.groupBy("session_id", "first_seq", "level", "message").agg(
        F.max_by("event_ts", "seq").alias("event_ts"), F.count("*").alias("entries")
    )


def recent_activity(collapsed: DataFrame, n: int = dims.BUFFER_ACTIVITY) -> DataFrame:
    """The newest ``n`` activities per session."""
    return newest_per_key(collapsed, ["session_id"], n, [F.col("first_seq").desc()])


def message_note() -> Column:
    """What a message of a session says about it; null if it says nothing.

    Events name their query, reports and errors have their own text, starting and stopping a fixed one. Needs
    ``kind``, ``record_type``, ``domain``, ``note`` and ``message``.
    """
    kind = F.col("kind")
    text = (
        F.when(kind == "event", fill(dims.NOTE_OBSERVED, F.col("record_type"), F.col("domain")))
        .when(kind == "status", F.col("note"))
        .when(kind.isin("error", "stderr"), F.col("message"))
        .when(kind == "stop", dims.NOTE_STOPPING)
        .when(kind == "start", dims.NOTE_PREPARING)
    )
    return non_empty(text)


def feed_notes(messages: DataFrame) -> DataFrame:
    """Messages as candidates of the activity feed: session_id, seq, kind, event_ts, level and message."""
    kind = F.col("kind")
    level = F.when(kind.isin("error", "stderr"), "error").when(kind == "stop", "warning").otherwise("info")
    return messages.select("session_id", "seq", "kind", "event_ts", level.alias("level"), message_note().alias("message"))


def activity_feed(messages: DataFrame, chunk_rows: int = dims.CHUNK_ROWS) -> DataFrame:
    """One feed per session: sampled events, reports' notes, errors and stop requests in order of arrival.

    Of the events the 1st, 5th and every 25th count; neighbours with equal text and level are folded into
    one entry with the time of the last. ``session_id, first_seq, level, message, event_ts, entries``.
    """
    noted = feed_notes(messages)
    ranked = with_rank(noted.filter("kind = 'event'"), ["session_id"], chunk_rows=chunk_rows)
    sampled = ranked.filter(F.col("rank").isin(*SAMPLED_FIRST) | (F.col("rank") % SAMPLED_EVERY == 0)).drop("rank")
    return collapse_activity(sampled.unionByName(noted.filter("kind <> 'event'")), chunk_rows)


# --- messages ----------------------------------------------------------------------


def status_messages(status: DataFrame) -> DataFrame:
    """Status records with their defaults: status ``running``, trimmed note."""
    return status.withColumns(
        {
            "status": F.coalesce(non_empty(strip(F.col("status"))), F.lit("running")),
            "note": F.coalesce(strip(F.col("note")), F.lit("")),
        }
    )


def error_messages(errors: DataFrame) -> DataFrame:
    """Error records with their default text."""
    text = F.coalesce(non_empty(F.col("message")), F.lit(dims.ERROR_UNKNOWN))
    return errors.withColumn("message", strip(text))


# --- ledger and status ---------------------------------------------------------------


def _resolved_status() -> Column:
    """Aggregate: the status of a session after its last message.

    Setters are errors, stop requests and reports of a non-terminal status. Events
    and terminal reports that follow a setter leave ``stopping`` alone and turn any
    other state into ``running``; a terminal report after a stop request gives
    ``stopping``.
    """
    kind, status, seq = F.col("kind"), F.col("status"), F.col("seq")
    terminal = (kind == "status") & status.isin(dims.TERMINAL_STATUSES)
    setter = (kind == "error") | (kind == "stop") | ((kind == "status") & ~terminal)
    value = F.when(kind == "error", "error").when(kind == "stop", "stopping").otherwise(status)
    set_at = F.max(F.when(setter, seq))
    set_to = F.max_by(F.when(setter, value), F.when(setter, seq))
    last_event = F.max(F.when(kind.isin("event", "status", "error", "stop"), seq))
    stop_at = F.min(F.when(kind == "stop", seq))
    last_terminal = F.max(F.when(terminal, seq))
    held = (last_terminal > stop_at) & (last_terminal > F.coalesce(set_at, F.lit(-1)))
    return (
        F.when(set_at == last_event, set_to)
        .when(set_to == "stopping", "stopping")
        .when(F.coalesce(held, F.lit(False)), "stopping")
        .when(last_event.isNotNull(), "running")
        .otherwise("starting")
    )


def session_status(messages: DataFrame) -> DataFrame:
    """Current status per session from its messages (``session_id``, ``seq``, ``kind``, ``status``).

    Only plain aggregates, so the same operator runs on a stream in update mode.
    While its producer lives a session cannot end: terminal reports are held.
    """
    return messages.groupBy("session_id").agg(
        _resolved_status().alias("status"),
        F.coalesce(F.max(F.col("kind") == "stop"), F.lit(False)).alias("stop_requested"),
    )


def final_status(status: Column, stop_requested: Column, exit_code: Column) -> Column:
    """Status once the producer has ended."""
    return (
        F.when(stop_requested & (status != "error"), "stopped")
        .when(status.isin("error", "stopped"), status)
        .when(exit_code == 0, "completed")
        .otherwise("error")
    )


def session_counters(events: DataFrame) -> DataFrame:
    """Events seen and last event time per session (batch, or stream in update mode)."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("events_seen"), F.max_by("event_ts", "seq").alias("last_event_at")
    )


def session_records(messages: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Sessions as the ledger on disk keeps them: id, status, tool, note, started_at, ended_at, last_event_at, events_seen, errors.

    ``messages`` as for ``session_ledger``, with ``note``, ``record_type`` and ``domain``; ``kind`` start opens a
    session (without one, its first time does). The note is what the last message with one says, or
    how the session ended. ``ends``: session_id, exit_code, ended_at. ``version``, the last arrival, tells which of two records of a session is newer.
    """
    told = F.col("kind") != "stderr"
    note = message_note()
    more = messages.groupBy("session_id").agg(
        F.max_by(F.when(told, note), F.when(told & note.isNotNull(), F.col("seq"))).alias("note"),
        F.coalesce(F.min(F.when(F.col("kind") == "start", F.col("event_ts"))), F.min("event_ts")).alias("started_at"),
        F.max("seq").alias("version"),
    )
    records = session_ledger(messages).join(more, "session_id")
    note = F.coalesce("note", F.lit(dims.NOTE_PREPARING))
    ended_at = F.lit(None).cast("timestamp")
    if ends is not None:
        ended = F.col("exit_code").isNotNull()
        records = records.join(ends.select("session_id", "exit_code", "ended_at"), "session_id", "left")
        how = (
            F.when(F.col("stop_requested") & (F.col("status") != "error"), dims.NOTE_STOPPED)
            .when(F.col("status").isin("error", "stopped"), note)
            .when(F.col("exit_code") == 0, dims.NOTE_COMPLETED)
            .otherwise(fill(dims.NOTE_EXITED, F.col("exit_code")))
        )
        note = F.when(ended, how).otherwise(note)
        ended_at = F.when(ended, F.col("ended_at"))
        closed = final_status(F.col("status"), F.col("stop_requested"), F.col("exit_code"))
        status = F.when(ended, closed).otherwise(F.col("status"))
    else:
        status = F.col("status")
    return records.select(
        F.col("session_id").alias("id"), status.alias("status"), "tool", note.alias("note"), "started_at",
        ended_at.alias("ended_at"), "last_event_at", "events_seen", "errors", "version",
    )


def session_ledger(messages: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """One record per session: events, last event, tool, status and the last six errors.

    ``messages`` are the session's records of all kinds with ``session_id``, ``seq``,
    ``kind`` (event, status, error, stop, stderr), ``event_ts``, ``tool``, ``status``
    and ``message``. ``stderr`` lines are errors that leave the status alone.
    ``ends`` (``session_id``, ``exit_code``) closes sessions.
    """
    is_event = F.col("kind") == "event"
    has_tool = F.col("kind").isin("event", "status") & non_empty(F.col("tool")).isNotNull()
    ledger = messages.groupBy("session_id").agg(
        F.count_if(is_event).alias("events_seen"),
        F.max_by(F.when(is_event, F.col("event_ts")), F.when(is_event, F.col("seq"))).alias("last_event_at"),
        F.max_by(F.when(has_tool, F.col("tool")), F.when(has_tool, F.col("seq"))).alias("tool"),
        _resolved_status().alias("status"),
        F.coalesce(F.max(F.col("kind") == "stop"), F.lit(False)).alias("stop_requested"),
    )
    errors = messages.filter(F.col("kind").isin("error", "stderr"))
    last = newest_per_key(errors, ["session_id"], dims.BUFFER_ERRORS, [F.col("seq").desc()])
    texts = last.groupBy("session_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "message"))), lambda e: e["message"]
        ).alias("errors")
    )
    ledger = ledger.join(texts, "session_id", "left").withColumn(
        "errors", F.coalesce("errors", F.array().cast("array<string>"))
    )
    if ends is not None:
        ledger = ledger.join(ends.select("session_id", "exit_code"), "session_id", "left")
        closed = final_status(F.col("status"), F.col("stop_requested"), F.col("exit_code"))
        status = F.when(F.col("exit_code").isNotNull(), closed).otherwise(F.col("status"))
        ledger = ledger.withColumn("status", status).drop("exit_code")
    return ledger


def history_count(sessions: DataFrame) -> DataFrame:
    """How many sessions are stored."""
    return sessions.agg(F.count("*").alias("history_count"))


def session_view(sessions: DataFrame) -> DataFrame:
    """Session list as shown: short id, upper-case mode, start, events, status."""
    label = F.substring(F.replace(F.coalesce("id", F.lit("unknown")), F.lit("session-"), F.lit("")), 1, 8)
    return sessions.select(
        label.alias("session"),
        F.upper(F.coalesce(non_empty(F.col("mode")), F.lit("live"))).alias("mode"),
        "started_at",
        F.coalesce("events_seen", F.lit(0)).cast("bigint").alias("events_seen"),
        "status",
    )
