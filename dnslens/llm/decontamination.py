"""Benchmark decontamination: n-gram seeds, an exact bound on the score, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import blocks, mix, read_table, text_bytes

SEED = 4
#: Text of the test items that one pass over the documents looks for; more items take more passes.
PASS_BYTES = 4 << 20
#: An alignment counts if its score is this share of the item's words.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 1.0, -1.0, -1.0
EDGES = ".,!?;:\"'()[]{}|<>*%#…«»"
CACHE_WORDS = 200_000


def item_words(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


class Items:
    """A bounded block of test items: word numbers, and the index of their n-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        words = {item: item_words(text or "") for item, text in items}
        self.vocabulary: dict[str, int] = {}
        for own in words.values():
            for word in own:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.words = {item: np.array([self.vocabulary[w] for w in own], np.int64) for item, own in words.items() if own}
        #: the distinct words and grams of each item; items shorter than a seed are one gram
        self.distinct = {item: np.unique(own) for item, own in self.words.items()}
        each = {item: np.unique(seeds_of(own, min(SEED, len(own)))) for item, own in self.words.items()}
        self.sizes = sorted({min(SEED, len(own)) for own in self.words.values()})
        grams = np.concatenate([np.zeros(0, np.int64), *each.values()])
        order = np.argsort(grams, kind="stable")
        #: the grams of all items; those that hold gram k are holders[starts[k] : starts[k + 1]]
        self.index, first = np.unique(grams[order], return_index=True)
        self.starts = np.append(first, len(grams))
        self.holders = np.repeat(np.array(list(each), np.int64), [len(g) for g in each.values()])[order]
        self.longest = max(map(len, self.words.values()), default=0)


def seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word numbers."""
    count = max(0, len(words) - n + 1)
    value = np.full(count, n, np.uint64)
    for k in range(n):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count].astype(np.uint64)
        value ^= value >> np.uint64(31)
    return mix(value).view(np.int64)


class _Numbers(dict):
    """Word -> number in the items' vocabulary (0: none), for a bounded number of words."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        bare = word.strip(EDGES)
        value = self[word] = self.vocabulary.get(bare, 0) if bare else -1
        return value


def _regions(words: np.ndarray, items: Items) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(start, word numbers, grams) of the stretches of a text that hold n-grams of the items, with room around."""
    at, grams = [], []
    for n in items.sizes:
        known = np.flatnonzero(words > 0)
        if n > 1:
            run = words > 0
            inside = run[: len(run) - n + 1].copy() if len(run) >= n else np.zeros(0, bool)
            for k in range(1, n):
                inside &= run[k : k + len(inside)]
            known = np.flatnonzero(inside)
        if len(known):
            value = seeds_of(np.concatenate([words[k : k + n] for k in known]), n)[::n] if len(known) * n < len(words) else seeds_of(words, n)[known]
            place = np.minimum(np.searchsorted(items.index, value), len(items.index) - 1)
            hit = items.index[place] == value
            at.append(known[hit])
            grams.append(value[hit])
    if not at or not sum(map(len, at)):
        return []
    at, grams = np.concatenate(at), np.concatenate(grams)
    order = np.argsort(at, kind="stable")
    at, grams = at[order], grams[order]
    cuts = np.flatnonzero(np.diff(at) > 2 * items.longest) + 1
    out = []
    for some, own in zip(np.split(at, cuts), np.split(grams, cuts), strict=True):
        start = max(0, int(some[0]) - items.longest)
        out.append((start, words[start : int(some[-1]) + SEED + items.longest], np.unique(own)))
    return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Best local alignment (Smith-Waterman, linear gaps): its score and the place in ``words`` where it ends.

    One step per word of the item; the gaps along ``words`` come from a running maximum.
    """
    slope = GAP * np.arange(len(words))
    before = np.zeros(len(words) + 1)
    best, end = 0.0, 0
    for word in item:
        row = np.maximum(before[:-1] + np.where(words == word, MATCH, MISMATCH), before[1:] + GAP)
        row = np.maximum(row, 0.0)
        row = np.maximum.accumulate(row - slope) + slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
        before[1:] = row
    return best, end


def _best_run(known: np.ndarray) -> int:
    """The greatest sum of a run, where true counts 1 and false -1."""
    sums = np.concatenate([[0], np.cumsum(np.where(known, 1, -1))])
    return int((sums - np.minimum.accumulate(sums)).max())


def _pairs(words: np.ndarray, grams: np.ndarray, items: Items, least: float, marks: np.ndarray) -> Iterator[int]:
    """The items that share a gram with a stretch of a text and may reach the score there.

    An alignment counts -1 for each word of either side that it spans and the other side lacks, so it
    scores no more than the best run of common words in the text, nor than that in the item. ``marks``:
    false for each word number.
    """
    at = np.searchsorted(items.index, grams)
    near = np.unique(words)
    for item in np.unique(np.concatenate([items.holders[items.starts[k] : items.starts[k + 1]] for k in at])).tolist():
        own, distinct = items.words[item], items.distinct[item]
        need = least * len(own)
        marks[distinct] = True
        reached = _best_run(marks[words]) >= need
        marks[distinct] = False
        if reached:
            marks[near] = True
            reached = _best_run(marks[own]) >= need
            marks[near] = False
        if reached:
            yield item


def _one_pass(docs: DataFrame, items: Items, least: float) -> DataFrame:
    """doc_id, item_id, score, end: for each stretch of the documents the items that it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, marks = _Numbers(items.vocabulary), np.zeros(len(items.vocabulary) + 1, bool)
        for batch in blocks(batches, "_text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                chunks = text.decode("utf-8", "replace").lower().split()
                numbers = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
                for start, words, grams in _regions(numbers[numbers >= 0], items):
                    for item in _pairs(words, grams, items, least, marks):
                        own = items.words[item]
                        score, end = align(own, words)
                        if score >= least * len(own):
                            rows.append((doc, item, score / len(own), start + end))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()),
            ], ["doc_id", "item_id", "score", "end"])

    return docs.mapInArrow(run, "doc_id long, item_id long, score double, end long")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
          min_score: float = MIN_SCORE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, item_id, score (1.0: verbatim), end (place of the last aligned word): the best alignment per pair.

    Words are compared lower-cased and without punctuation at their ends. A pair is aligned if the document
    holds any n-gram of the item, however common, and an exact bound does not rule the score out. Items shorter
    than a seed are found where all their words stand together; null, empty and wordless items match nothing, and
    so do null and empty texts. Rows with a null key or item are left out; repeated rows of one key are
    searched each and give one row per item. Other columns are not carried; an empty table on either
    side gives none. Items go out in blocks of bounded size, each with a pass over the documents.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("_text")).filter("doc_id is not null")
    tests = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("_item")).filter("item_id is not null")
    tests = tests.groupBy("item_id").agg(F.max("_item").alias("_item"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("_item")), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    out = None
    for number in range(passes):
        own = tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number) if passes > 1 else tests
        items = Items([(r.item_id, r._item) for r in own.orderBy("item_id").collect()])
        if items.words:
            found = _one_pass(plain, items, min_score)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end long")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.score", "best.end")


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
