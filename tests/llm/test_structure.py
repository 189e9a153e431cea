"""Divergence audit, conversation repair and packing against plain second writings."""

from __future__ import annotations

import bisect
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnslens.llm import divergence, packing, repair

CONVERSATION = "conv_id long, turn long, role string, text string"


# --- divergence ---------------------------------------------------------------------------


def plain_divergences(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) from dense counts of every term and group."""
    documents = [((lang or ""), (source or ""), [w.translate(str.maketrans(divergence.UPPER, divergence.LOWER))
                                                  for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in documents}:
        own = [d for d in documents if d[0] == lang]
        inside = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in inside.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if inside[w] >= least)
        whole = sum(counts.values(), Counter())

        def shares(count):
            size = sum(count.values()) + len(kept)
            return {w: 1 + 10**9 * (count[w] + 1) // size for w in kept}

        p, q_lang = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for a in counts:
            found = [(b, sum((p[a][w] - p[b][w]) ** 2 // p[b][w] for w in kept)) for b in counts if b != a]
            terms = [(w, (p[a][w] - q_lang[w]) ** 2 // q_lang[w]) for w in kept if counts[a][w] and p[a][w] > q_lang[w]]
            for part, items in (("pair", found), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, a, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top}
    return out


def test_divergences(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Alpha", "beta", "gamma", "ünder", "日本", "x", "the", "THE", "a1b", "rare-", "İx"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice([None, "s1", "s2", "s3", "ß"]),
             None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for _ in range(150)]
    rows += [("fr", "only", "unseen words"), ("fr", "other", None), ("it", "s1", ""), ("en", "s1", "the " * 5000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    clashing = docs.select("*", *[F.lit(1).alias(x) for x in ("term", "count", "number", "value", "item", "_text", "total")])
    want = plain_divergences(rows)
    assert {tuple(r) for r in divergence.divergences(clashing).collect()} == want
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 5)  # several blocks of terms, of rows and of steps
    monkeypatch.setattr(divergence, "ROW_BLOCK", 2)
    monkeypatch.setattr(divergence, "BLOCK_TEXT", 30)
    assert {tuple(r) for r in divergence.divergences(docs).collect()} == want
    few = divergence.divergences(docs, top_terms=2).filter("part = 'term'")
    assert {tuple(r) for r in few.collect()} == {x for x in want if x[2] == "term" and x[5] <= 2}
    assert divergence.divergences(docs.limit(0)).count() == 0


def test_accumulate_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    group, term = rng.integers(0, 7, 300), rng.integers(0, 40, 300)
    pairs = np.unique(np.stack([term, group]), axis=1)
    count, total = rng.integers(1, 50, pairs.shape[1]), rng.integers(50, 500, 7)
    whole = dict(divergence.accumulate(pairs[0], pairs[1], count, total, np.arange(7)))
    dense = np.zeros((40, 7), np.int64)
    dense[pairs[0], pairs[1]] = count
    dense = dense[dense.any(axis=1)]
    shares = 1 + 10**9 * (dense + 1) // total
    monkeypatch.setattr(divergence, "STEP", 10)
    for a, sums in divergence.accumulate(pairs[0], pairs[1], count, total, np.arange(7)):
        want = ((shares[:, [a]] - shares) ** 2 // shares).sum(axis=0)
        assert (sums == want).all() and (whole[a] == want).all()


def test_shares_of_large_counts(spark):
    big = 40_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 1) // (big + 7)


# --- repair -------------------------------------------------------------------------------------


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        flat = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not flat else "d" if (role, text) in seen else "t" if flat[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns): the first goal of a search ordered by cost, then by the audit itself."""
    fault, heap, done = faults(rows), [(0, "", 0, "0", ())], set()
    while True:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in "0a":
            return cost, audit, turns
        onward = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[onward]
        heapq.heappush(heap, (cost + 3, audit + "I", at, onward, (*turns, (name, ""))))
        if at == len(rows):
            continue
        role, text = rows[at]
        more = 3 if fault[at] == "t" else 0
        heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, turns))
        if fault[at] not in ("b", "d"):
            heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, onward, (*turns, (name, text))))
            if role[:1] == onward or role[:1] == "s" and state == "0":
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*turns, (role, text))))


def plain_repairs(table):
    held = defaultdict(list)
    for conv, turn, role, text in table:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind, role, text = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20, shown[2], shown[3]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        told = faults([x[1:] for x in rows])
        cost, audit, turns = cheapest([x[1:] for x in rows])
        dated = {x[0] for x in rows} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (max(dated) - min(dated) + 1 - len(dated) if dated else 0, *[told.count(x) for x in "bdt"], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest())
    return out


@pytest.mark.parametrize("together", [repair.TOGETHER, 7])
def test_repairs(spark, sample, monkeypatch, together):
    monkeypatch.setattr(repair, "TOGETHER", together)
    rng = random.Random(3)
    table = [(conv, rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u", "Sys"]),
              rng.choice(["a.", "b", "", " ", None, "Hi!", "what? ", "x\n", "é", "ok."])) for conv in [None, *range(60)] for _ in range(rng.randrange(0, 30))]
    table += [tuple(r) for r in spark.read.parquet(f"{sample}/conversations.parquet").selectExpr("conv_id + 1000", "turn", "role", "text").collect()]
    rows = spark.createDataFrame(table, CONVERSATION).withColumn("digest", F.lit("x")).withColumn("part", F.lit(1))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_digests(repair.damage(rows), rows.select("conv_id")).collect()}
    assert got == plain_repairs(table)


def test_repair_of_nothing(spark):
    rows = spark.createDataFrame([], CONVERSATION)
    assert repair.repair_digests(repair.damage(rows), rows.select("conv_id")).count() == 0
    ids = spark.createDataFrame([(5,), (None,), (5,)], "conv_id long")
    nothing = hashlib.sha256(b"").hexdigest()
    got = {tuple(r) for r in repair.repair_digests(rows, ids).collect()}
    assert got == {(5, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)}


def test_long_conversation(spark):
    """One conversation of many rows, over several Arrow batches, every third role wrong."""
    rows = spark.range(25_000).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "id || '.' AS text")
    table = [("user" if k % 3 == 0 else "assistant", f"{k}.") for k in range(3_000)]
    short = repair.reports(rows.filter("turn < 3000")).first()
    cost, audit, _ = cheapest(table)
    assert (short["cost"], short["audit"]) == (cost, audit)
    turns = repair.repaired(rows)
    initials = "".join(r[0] for r in turns.orderBy("position").selectExpr("left(role, 1)").collect())
    assert re.fullmatch("s?(ua)*", initials) and turns.agg(F.max("position")).first()[0] + 1 == len(initials)


# --- packing --------------------------------------------------------------------------------


def best_fit_decreasing(sizes, capacity):
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        n += at == len(gaps)
        gap = (capacity if at == len(gaps) else gaps.pop(at)) - size
        if gap:
            bisect.insort(gaps, gap)
    return n


def check_places(rows, capacity):
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    return len(held)


@pytest.mark.parametrize("name", ["even", "short", "copies", "third"])
def test_best_fit(spark, monkeypatch, name):
    rng = random.Random(4)
    monkeypatch.setattr(packing, "CLASS_ROWS", 50)  # classes of many rows are ranked in buckets
    sizes = {"even": [rng.randrange(1, 65) for _ in range(700)], "short": [rng.randrange(1, 7) for _ in range(700)],
             "copies": [23] * 300 + [rng.randrange(1, 40) for _ in range(300)], "third": [22] * 400}[name]
    items = spark.createDataFrame([(k, size) for k, size in enumerate(sizes)], "item long, size int")
    rows = packing.best_fit(items, 64).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    n = check_places([(r["sequence_id"], r["offset"], sizes[r["item"]]) for r in rows], 64)
    assert n <= best_fit_decreasing(sizes, 64) + 1


def test_sweep_takes_successors():
    heights = packing.sweep({5: 2, 3: 4}, {6: 1, 5: 1, 3: 1})
    assert heights == {6: (0, 0, 0), 5: (1, 1, 2), 3: (0, 0, 1)}
    assert packing.least_bins({33: 3, 5: 1}, 64) == 3 and packing.least_bins({22: 5}, 64) == 3 and packing.least_bins({}, 64) == 0


def test_taken_slots_alone_become_rows(spark, monkeypatch):
    """A few documents of the largest size and many short ones: all rounds' slots are no more than the documents."""
    rng = random.Random(6)
    sizes = [40, 30, 20, 12] * 4 + [rng.randrange(3, 7) for _ in range(900)]
    kept, staged = [], packing.staged

    def counted(df):
        out = staged(df)
        if "used" in out.columns:
            kept.append(out.filter("kind = 0").count() - out.filter("kind = 0").select("id").distinct().count())
        return out

    monkeypatch.setattr(packing, "staged", counted)
    items = spark.createDataFrame([(k, size) for k, size in enumerate(sizes)], "item long, size int")
    rows = packing.best_fit(items, 64).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    assert check_places([(r["sequence_id"], r["offset"], sizes[r["item"]]) for r in rows], 64) <= best_fit_decreasing(sizes, 64) + 1
    assert sum(kept) <= len(sizes)


def test_topmost():
    """As many slots as a pile of them loses, size by size."""
    rng = random.Random(8)
    for _ in range(200):
        docs, slots = ({rng.randrange(1, 12): rng.randrange(1, 9) for _ in range(rng.randrange(1, 7))} for _ in range(2))
        pile, lost = [], dict.fromkeys({*docs, *slots}, 0)
        for size in sorted(lost, reverse=True):
            pile += [size] * slots.get(size, 0)
            for _ in range(min(docs.get(size, 0), len(pile))):
                lost[pile.pop()] += 1
        assert packing.topmost(docs, slots, packing.sweep(docs, slots)) == lost


def test_byte_bpe_ids():
    """Ids equal the library's, for texts of every character of the fast way and for others."""
    coder, rng = packing.ByteBpe(packing.default_path()), random.Random(1)
    known = [chr(x) for x in [*range(0x234), *range(0x2010, 0x2028), 0x20AC]]
    other = [*known, "日", "Ω", "😀", " ", "̀", "<|endoftext|>"]
    for letters in (known, other):
        for _ in range(6_000):
            text = "".join(rng.choice(letters) if rng.random() < 0.6 else rng.choice(" \n'sretvdlmA1.") for _ in range(rng.randrange(0, 12)))
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder._tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packed_documents(spark, edges, edge_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    cut = packing.staged(packing.pieces(edges, ids=True))
    rows = packing.packed(cut).collect()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"]) <= 1024
        if r["doc_id"] is not None and r["doc_id"] != 5:
            assert r["start"] == len(whole[r["doc_id"]]) and (r["piece"] == 0 or r["length"] == 1024)
            whole[r["doc_id"]] += r["ids"]
    for doc, text in edge_rows:
        if doc is not None and doc != 5:
            assert whole[doc] == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert len([r for r in rows if r["doc_id"] == 5]) == 2
    n = check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 1024)
    built = packing.sequences(edges).collect()
    assert len(built) == n and sorted(map(len, [r["ids"] for r in built])) == sorted(sum(p["length"] for p in r["parts"]) for r in built)
    assert packing.packed(packing.staged(packing.pieces(edges.limit(0)))).count() == 0
