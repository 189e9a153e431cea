"""Repair of conversations: the cheapest edits that make the turns alternate, least audit first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnslens.llm.common import read_table

#: Letters of the edits, in the order in which ties are settled.
LABELS = "DIKR"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing kept yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: A symbol is the class of a role's initial (s, u, a, other) plus four times the first fault.
INITIALS = "sua"
FINE, CUT, BLANK, COPY = range(4)
#: Cost of what cannot be.
NEVER = 1 << 40
#: Rows of whole conversations that are ranked together.
TOGETHER = 1 << 15
#: State after a turn that is put in or renamed, by the state before.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
#: Order of the rows of a conversation; nulls come first.
ORDER = ["turn", "role", "digest"]


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and next state of each edit (delete, insert, keep, rerole), by symbol and state."""
    cost = np.full((16, 4, 4), NEVER, np.int64)
    to = np.zeros((16, 4, 4), np.int64)
    for symbol in range(16):
        initial, fault = symbol % 4, symbol // 4
        more = TRUNCATED if fault == CUT else 0
        for state in range(4):
            cost[symbol, state, :2] = DELETE, INSERT
            to[symbol, state] = state, NEXT[state], min(initial + 1, ASSISTANT), NEXT[state]
            if fault in (BLANK, COPY):
                continue
            cost[symbol, state, 3] = REROLE + more
            if initial == 0 and state == START or initial in (1, 2) and initial + 1 == NEXT[state]:
                cost[symbol, state, 2] = more
    return cost, to


COST, TO = _arcs()


def _rows() -> np.ndarray:
    """Least cost from state to state by one row of each symbol, with turns put in before it."""
    put = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        put[state, state] = 0
        put[state, NEXT[state]] = min(put[state, NEXT[state]], INSERT)
        again = NEXT[NEXT[state]]
        put[state, again] = min(put[state, again], 2 * INSERT)
    out = np.full((16, 4, 4), NEVER, np.int64)
    for symbol in range(16):
        for state in range(4):
            for label in (0, 2, 3):
                out[symbol, state, TO[symbol, state, label]] = min(out[symbol, state, TO[symbol, state, label]], COST[symbol, state, label])
    return _product(np.broadcast_to(put, out.shape), out)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cheapest ways through two stretches, one after the other."""
    out = left[:, :, 0, None] + right[:, None, 0, :]
    for k in range(1, 4):
        np.minimum(out, left[:, :, k, None] + right[:, None, k, :], out=out)
    return np.minimum(out, NEVER)


ROWS = _rows()
#: Cost of what must still be put in at the end of a conversation, by state.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def costs(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cost to the end from each column (a row, or the end of a conversation) and state.

    ``symbols`` has one entry for each column, ``first`` and ``last`` are the columns of each
    conversation. Stretches double: after step k a column knows the way through 2^k rows.
    """
    stop = np.repeat(last, last - first + 1)
    at = np.arange(len(symbols))
    way = ROWS[symbols]
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    way[last] = unit
    step = 1
    while step <= int((last - first).max(initial=0)):
        way = _product(way, way[np.minimum(at + step, stop)])
        step *= 2
    return (way + END[None, None, :]).min(axis=2)


def audits(symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per conversation the least cost, the number of edits and the least audit of that cost.

    A node is a column and a state; its optimal arcs are the edits that lie on a cheapest way. An edit's
    letter leads from a node to one node, so a node's least audit of 2^k letters is one path. Nodes are
    ranked by it: by their least letter first, then by their own rank and that of the node which the
    path of 2^k letters reaches, with pointers that double. The ranks of whole audits then choose each
    node's arc, and the doubled pointers of the chosen arcs give the node after any number of edits.
    """
    cost = costs(symbols, first, last)
    columns = len(symbols)
    end = columns * 4
    column, state = np.divmod(np.arange(end), 4)
    is_last = np.zeros(columns, bool)
    is_last[last] = True
    to = TO[symbols].reshape(end, 4)
    target = (column[:, None] + np.array([1, 0, 1, 1])) * 4 + to
    price = COST[symbols].reshape(end, 4).copy()
    price[is_last[column]] = [NEVER, INSERT, NEVER, NEVER]
    ahead = np.append(cost.reshape(-1), np.zeros(4, np.int64))
    optimal = price + ahead[np.minimum(target, end)] == cost.reshape(end, 1)
    done = ~optimal.any(axis=1)  # nothing to do any more: the audit ends here
    target = np.where(optimal, target, end)

    letter = np.where(done, 0, optimal.argmax(axis=1) + 1)
    rank = np.append(letter, 0)
    onward = np.append(np.where(done, end, target[np.arange(end), np.maximum(letter - 1, 0)]), end)
    size, known = len(np.unique(rank)), 0
    while not (onward == end).all() and known < size:  # ranks that split no further are final
        known = size
        pair = rank * (int(rank.max()) + 1) + rank[onward]
        values, rank = np.unique(pair, return_inverse=True)
        size, onward = len(values), onward[onward]
    most = int(rank.max()) + 1
    choice = np.where(optimal, np.arange(4)[None, :] * most + rank[target], 5 * most).argmin(axis=1)
    jump = [np.append(np.where(done, end, target[np.arange(end), choice]), end)]
    while not (jump[-1] == end).all():
        jump.append(jump[-1][jump[-1]])

    begin = first * 4
    length, node = np.zeros(len(first), np.int64), begin.copy()
    for k in reversed(range(len(jump))):  # the most steps that do not reach the end, plus the last one
        onto = jump[k][node]
        length += np.where(onto != end, 1 << k, 0)
        node = np.where(onto != end, onto, node)
    total = int(length.sum())
    owner = np.repeat(np.arange(len(first)), length)
    step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    node = begin[owner]
    for k in range(len(jump)):
        node = np.where(step >> k & 1, jump[k][node], node)
    text = np.frombuffer(LABELS.encode(), np.uint8)[choice[node]].tobytes().decode()
    cut = np.cumsum(length)
    return cost[first, START], length, [text[a:b] for a, b in zip((cut - length).tolist(), cut.tolist(), strict=True)]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` (nulls: one space), damaged by the CRC of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks away,
    3 repeats it, 4 makes it the user's. conv_id and turn keep their nulls.
    """
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    plain = rows.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind")).filter("kind <> 0")
    once = plain.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return once.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _symbol() -> Column:
    """The symbol of a row: initial of its role, and first fault (blank, seen before, not ended)."""
    initial = F.lit(3)
    for k, letter in enumerate(INITIALS):
        initial = F.when(F.col("role").startswith(letter), k).otherwise(initial)
    fault = F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, COPY).when(F.col("cut"), CUT).otherwise(FINE)
    return (initial + 4 * fault).cast("int")


def _conversations(batches: Iterable[pa.RecordBatch], together: int) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole conversations, about ``together`` rows each or one long conversation."""
    held: list[pa.RecordBatch] = []
    rows, final = 0, None
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("conv_id")
        key = np.stack([ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)], axis=1)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        new[0] = final is None or (key[0] != final).any()
        final = key[-1]
        starts = np.flatnonzero(new)
        if len(starts) and rows + len(batch) >= together:
            cut = int(starts[-1])
            if rows + cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], len(batch) - cut
        else:
            held.append(batch)
            rows += len(batch)
    if rows:
        yield pa.Table.from_batches(held)


def _measure(table: pa.Table) -> pa.RecordBatch:
    """Counts, cost and audit of each conversation of a table of whole ones."""
    ids = table.column("conv_id").combine_chunks()
    nothing = ids.is_null().to_numpy(zero_copy_only=False)
    key = ids.fill_null(0).to_numpy(zero_copy_only=False)
    turns = table.column("turn").combine_chunks()
    turn, no_turn = turns.fill_null(0).to_numpy(zero_copy_only=False), turns.is_null().to_numpy(zero_copy_only=False)
    symbol = table.column("symbol").combine_chunks().to_numpy(zero_copy_only=False)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (nothing[1:] != nothing[:-1])
    starts = np.flatnonzero(new)
    owner = np.cumsum(new) - 1
    count = len(starts)
    there = symbol >= 0
    n = np.bincount(owner[there], minlength=count)

    def per_owner(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=count).astype(np.int64)

    dated = there & ~no_turn
    at = np.flatnonzero(dated)  # turns rise within a conversation
    other = np.ones(len(at), bool)
    other[1:] = (turn[at][1:] != turn[at][:-1]) | (owner[at][1:] != owner[at][:-1])
    distinct = np.bincount(owner[at][other], minlength=count)
    low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min)
    np.minimum.at(low, owner[at], turn[at])
    np.maximum.at(high, owner[at], turn[at])
    gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)

    held, whose = symbol[there], owner[there]
    initial = held % 4
    legal = np.isin(initial[:-1] * 4 + initial[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    illegal = np.bincount(whose[1:][~legal & (whose[1:] == whose[:-1])], minlength=count).astype(np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    last = first + n
    symbols = np.zeros(len(held) + count, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[last] = False
    symbols[inner] = held
    cost, _, audit = audits(symbols, first, last)
    fault = np.where(there, symbol // 4, FINE)
    columns = [ids.take(pa.array(starts)), pa.array(gaps), *[pa.array(per_owner(fault == x)) for x in (BLANK, COPY, CUT)],
               pa.array(illegal), pa.array(cost), pa.array(audit, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def reports(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``rows``: conv_id, turn, role, text, no null role or text. Rows are taken by turn (nulls first), equal turns by
    role and digest of the text. ``ids`` names conversations (conv_id) that are reported even without a
    row, with zeros and an empty audit. Rows with a null conv_id are one conversation. Only a symbol a
    row, its turn and digest are shuffled, not the texts; a conversation's symbols are ranked in one task,
    a few hundred bytes a row, as its audit is one string anyway.
    """
    tail = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    marks = rows.select("conv_id", "turn", "role", _digest().alias("digest"), (tail == "").alias("blank"),
                        (~tail.isin(".", "!", "?")).alias("cut"), F.lit(True).alias("there"))
    if ids is not None:
        marks = marks.unionByName(ids.select("conv_id", F.lit(False).alias("there")).distinct(), allowMissingColumns=True)
    same = Window.partitionBy("conv_id", "there", "role", "digest").orderBy("turn")
    dealt = marks.repartition(F.col("conv_id")).withColumn("nth", F.row_number().over(same))
    seen = dealt.select("conv_id", "turn", "role", "digest", F.when(F.col("there"), _symbol()).otherwise(-1).alias("symbol"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _conversations(batches, TOGETHER):
            yield _measure(table)

    plain = seen.sortWithinPartitions("conv_id", *ORDER).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "symbol")
    return plain.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn that an audit keeps, renames or puts in, as the rows pass by."""
    state = START
    for label in audit:
        role, text = next(rows) if label != "I" else ("", "")
        if label == "D":
            continue
        if label == "K":
            state = INITIALS.index(role[:1]) + 1
        else:
            state = int(NEXT[state])
            role = "user" if state == USER else "assistant"
        yield label, role, text


def _with_reports(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's report and then its rows, sorted, in one partition."""
    plain = rows.select("conv_id", "turn", "role", "text", _digest().alias("digest"), F.lit(1).alias("part"))
    both = plain.unionByName(found.withColumn("part", F.lit(0)), allowMissingColumns=True)
    return both.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part", *ORDER).drop("digest")


class _Rows:
    """Rows of Arrow batches, one at a time; ``turns`` are those up to the next report."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self._rows = (row for batch in batches for part in range(0, len(batch), 256) for row in batch.slice(part, 256).to_pylist())
        self.head = next(self._rows, None)

    def turns(self) -> Iterator[tuple[str, str]]:
        self.head = next(self._rows, None)
        while self.head is not None and self.head["part"] == 1:
            row = self.head
            self.head = next(self._rows, None)
            yield row["role"], row["text"]


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, edit (K, R or I), role, text of the repaired conversations; cases as in ``reports``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, out = _Rows(batches), []
        while stream.head is not None:
            report, turns = stream.head, stream.turns()
            for position, (label, role, text) in enumerate(edited(report["audit"], turns)):
                out.append((report["conv_id"], position, label, role, text))
                if len(out) >= 1000:
                    yield _batch(out, fields)
                    out = []
            for _ in turns:  # deleted ones at the end
                pass
        if out:
            yield _batch(out, fields)

    fields = [("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    found = reports(rows).select("conv_id", "audit")
    return _with_reports(rows, found).mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)],
                                      [name for name, _ in fields])


def repair_digests(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``reports`` and repaired_sha256: digest of the repaired ``role:text`` turns, joined by line feeds.

    The turns are digested while they pass by, in order, so a conversation of any length needs the
    memory of its audit and one batch.
    """
    found = reports(rows, ids)
    names = [*found.columns, "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, out = _Rows(batches), []
        while stream.head is not None:
            report, turns = stream.head, stream.turns()
            digest = hashlib.sha256()
            for position, (_, role, text) in enumerate(edited(report["audit"], turns)):
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            for _ in turns:
                pass
            out.append((*[report[name] for name in names[:-1]], digest.hexdigest()))
            if len(out) >= 1000:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    kinds = {"audit": pa.string(), "repaired_sha256": pa.string()}
    fields = [(name, kinds.get(name, pa.int64())) for name in names]
    schema = ", ".join(f"{name} {'string' if name in kinds else 'long'}" for name in names)
    return _with_reports(rows, found).mapInArrow(run, schema)


def op12_conversation_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged by rule, with their faults, the least audit of the cheapest repair and its digest."""
    rows = read_table(spark, folder, "conversations")
    return repair_digests(damage(rows), rows.select("conv_id"))


def _sql() -> str:
    """The same rows as one SQL statement: states of the least (cost, audit) are carried from row to row."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def arc(state: str, cost: str, letter: str, turn: str | None = None, when: str = "true") -> str:
        turns = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
        return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000 END, 'a': {state}.a || '{letter}', 't': {turns}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def put(state: str, role: str) -> str:
        return arc(state, str(INSERT), "I", f"'{role}:'")

    kept = "m.fault IN ('', 'cut')"
    more = f"CASE WHEN m.fault = 'cut' THEN {TRUNCATED} ELSE 0 END"

    def into(own: str, befores: list[str], role: str) -> str:
        options = [arc(own, str(DELETE), "D")]
        for state in befores:
            options += [arc(state, more, "K", "m.role || ':' || m.text", f"{kept} AND m.role LIKE '{role[0]}%'"),
                        arc(state, f"{REROLE} + {more}", "R", f"'{role}:' || m.text", kept)]
        return least(*options)

    start = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    never = "{'c': CAST(1000000 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}"
    return f"""
WITH RECURSIVE shown AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
steps AS (SELECT *, flatten(list_transform(string_split(key, ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM shown),
kinds AS (
    SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), ops), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
           WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM steps),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n, rtrim(text, {blanks}) AS flat FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM placed),
marked AS (
    SELECT *, CASE WHEN flat = '' THEN 'blank' WHEN nth > 1 THEN 'copy' WHEN right(flat, 1) NOT IN ('.', '!', '?') THEN 'cut' ELSE '' END AS fault,
           lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS ahead FROM seen),
walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, {start} AS s0, {never} AS s1, {put(start, "user")} AS s2,
           {put(put(start, "user"), "assistant")} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, n, s0, s1, s2, {least("s3", put("s2", "assistant"))} FROM (
        SELECT conv_id, n, s0, s1, {least("s2", *[put(x, "user") for x in ("s0", "s1", "s3")])} AS s2, s3 FROM (
            SELECT w.conv_id, m.n, {arc("w.s0", str(DELETE), "D")} AS s0,
                   {least(arc("w.s1", str(DELETE), "D"), arc("w.s0", more, "K", "m.role || ':' || m.text", f"{kept} AND m.role LIKE 's%'"))} AS s1,
                   {into("w.s2", ["w.s0", "w.s1", "w.s3"], "user")} AS s2, {into("w.s3", ["w.s2"], "assistant")} AS s3
            FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1))),
final AS (
    SELECT conv_id, {least("s0", "s3")} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'copy') AS duplicate, count(*) FILTER (fault = 'cut') AS truncated,
           count(*) FILTER (n > 1 AND left(ahead, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM final f LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""


SQL = _sql()
