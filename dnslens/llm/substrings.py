"""Substring dedup: windows of words counted in the buckets of their minimisers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import BLOCK_BYTES, WordHashes, blocks, grams, read_table, squeezed, staged, text_bytes, unsqueezed
from dnslens.session import broadcast_if_small

WINDOW = 50
#: Words of the run whose least hash in a window names the window's bucket.
MINIMISER = 8
#: A bucket with more distinct strings is dealt out anew by whole windows.
SPLIT_STRINGS = 20_000


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _super_runs(words: np.ndarray, starts: np.ndarray, window: int, size: int):
    """(row, start, windows, minimiser) of the longest runs of windows of a text that share a minimiser."""
    empty = np.zeros(0, np.int64)
    if len(words) < window:
        return empty, empty, empty, empty
    least = _window_min(grams(words, size), window - size + 1)
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    inside = np.arange(len(least)) + window <= starts[1:][row]  # the window ends within its text
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty
    least, row = least[at].view(np.int64), row[at]
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], at[first] - starts[row[first]], np.diff(np.append(first, len(at))), least[first]


def super_kmers(docs: DataFrame, window: int, size: int) -> DataFrame:
    """One row per super-k-mer: minimiser, doc_id, start, n (windows); no words yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches, "_text"):
            words, starts = hashes.of(batch.column("_text").to_pylist())
            row, start, n, least = _super_runs(words, starts, window, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least), batch.column("doc_id").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                ["minimiser", "doc_id", "start", "n"])

    return docs.mapInArrow(run, "minimiser long, doc_id long, start int, n int")


def packed(shared: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The super-k-mers of ``shared`` with their words: minimiser, doc_id, start, key, words.

    ``words`` is the run's text, words joined by one blank; ``key`` its 128-bit digest.
    """
    wanted = shared.groupBy("doc_id").agg(F.collect_list(F.struct("minimiser", "start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            for ids, text, runs in zip(batch.column("doc_id"), unsqueezed(batch.column("_text")), batch.column("runs").to_pylist(), strict=True):
                words = text.split()
                runs = [r for r in runs if r["start"] + r["n"] + window - 1 <= len(words)]
                for at in range(0, len(runs), 2000):
                    some = runs[at : at + 2000]
                    texts = [b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1]) for r in some]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["minimiser"] for r in some], pa.int64()), pa.array([ids.as_py()] * len(some), pa.int64()),
                        pa.array([r["start"] for r in some], pa.int32()), pa.array([xxhash.xxh128_digest(x) for x in texts], pa.binary()),
                        pa.array(texts, pa.binary()),
                    ], ["minimiser", "doc_id", "start", "key", "words"])

    return squeezed(docs).join(wanted, "doc_id").mapInArrow(run, "minimiser long, doc_id long, start int, key binary, words binary")


def _count_bucket(hashes: WordHashes, keys: list, texts: list[bytes], first: np.ndarray, window: int) -> pa.RecordBatch:
    """Sorts the windows of the strings and gives each string its runs of windows with the first document of each."""
    words, starts = hashes.of(texts)
    counts = np.diff(starts) - window + 1
    string = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[:-1][string] + offset
    one, two = grams(words, window, 1)[at], grams(words, window, 2)[at]
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(first[string][order], np.flatnonzero(new))[group]
    doc = np.empty_like(least)
    doc[order] = least
    # runs of neighbouring windows of a string with the same first document
    cut = np.append(True, (doc[1:] != doc[:-1]) | (string[1:] != string[:-1]))
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(doc)))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()).take(pa.array(string[begin])), pa.array(offset[begin].astype(np.int32)),
         pa.array(length.astype(np.int32)), pa.array(doc[begin])], ["key", "offset", "n", "first"])


def first_documents(strings: DataFrame, window: int) -> DataFrame:
    """key, offset, n, first: runs of windows of each string, with the least doc_id that has them.

    ``strings``: bucket, key, words, first. Each bucket lies in one task, sorted behind the others there;
    whole buckets are gathered to blocks, so memory holds one block or the largest bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        keys: list = []
        texts: list[bytes] = []
        first: list[int] = []
        size, last = 0, None
        for batch in batches:
            for bucket, key, words, doc in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > BLOCK_BYTES and bucket != last:
                    yield _count_bucket(hashes, keys, texts, np.array(first, np.int64), window)
                    keys, texts, first, size = [], [], [], 0
                last = bucket
                keys.append(key)
                texts.append(words)
                first.append(doc)
                size += len(words)
        if keys:
            yield _count_bucket(hashes, keys, texts, np.array(first, np.int64), window)

    dealt = strings.select("bucket", "key", "words", "first").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key binary, offset int, n int, first long")


def _single_windows(strings: DataFrame, window: int) -> DataFrame:
    """Each window of the strings as a string of its own, in the bucket of its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words", BLOCK_BYTES // 16):
            rows = []
            for key, text, doc in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist(), batch.column("first").to_pylist(), strict=True):
                words = text.split()
                for at in range(len(words) - window + 1):
                    rows.append((key, at, xxhash.xxh128_digest(b" ".join(words[at : at + window])), doc))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())],
                ["key", "offset", "window", "doc"])

    return strings.mapInArrow(run, "key binary, offset int, window binary, doc long")


def repeated_runs(docs: DataFrame, window: int = WINDOW, size: int = MINIMISER, split: int = SPLIT_STRINGS) -> DataFrame:
    """doc_id, start, n: runs of windows of a document that also start in one with a smaller doc_id.

    ``docs``: doc_id, _text (bytes). Two equal windows have the same minimiser, so one that occurs in a
    single document needs no further look: only super-k-mers of a minimiser that two documents share
    are packed and sent to its bucket. Equal strings are folded before they are shuffled. Buckets with
    more than ``split`` distinct strings are dealt out by single windows, each folded on the map side.
    """
    runs = staged(super_kmers(docs, window, size))
    shared = runs.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    found = staged(packed(runs.join(shared.select("minimiser"), "minimiser"), docs, window))
    sizes = found.select("minimiser", "key").distinct().groupBy("minimiser").count().filter(F.col("count") > split)
    large = broadcast_if_small(staged(sizes.select("minimiser")))
    strings = found.groupBy(F.col("minimiser").alias("bucket"), "key").agg(F.first("words").alias("words"), F.min("doc_id").alias("first"))
    by_bucket = large.withColumnRenamed("minimiser", "bucket")
    counted = first_documents(strings.join(by_bucket, "bucket", "left_anti"), window)
    singles = _single_windows(strings.join(by_bucket, "bucket"), window)
    least = singles.groupBy("window").agg(F.min("doc").alias("first"))
    again = singles.join(least, "window").select("key", "offset", F.lit(1).alias("n"), "first")
    firsts = counted.unionByName(again)
    # a string's earliest document is among its own, so only windows of an earlier one matter
    return (
        found.select("key", "doc_id", "start").join(firsts, "key").filter("first < doc_id")
        .select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n")
    )


def _keep(text: bytes, runs: list | None, window: int) -> tuple[list[bytes], int]:
    words = text.split()
    if not runs:
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for run in runs:
        gone[run["start"]] += 1
        gone[min(len(words), run["start"] + run["n"] + window - 1)] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)], len(words)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, size: int = MINIMISER,
          split: int = SPLIT_STRINGS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, text (the kept words, joined by one blank).

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller
    ``key``; windows are judged on the input. Null and empty texts have no words; texts shorter than a
    window lose none. Repeated rows of one ``key`` count as one document and do not repeat each other:
    their windows are judged by place, so they should be equal. Rows with a null ``key`` keep their words.
    Other columns are not carried and may have any name; an empty table gives none.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("_text"))
    runs = repeated_runs(plain.filter("doc_id is not null"), window, size, split)
    lost = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            rows = [_keep(x, r, window) for x, r in zip(unsqueezed(batch.column("_text")), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([n for _, n in rows], pa.int64()),
                pa.array([n - len(kept) for kept, n in rows], pa.int64()),
                pc.cast(pa.array([b" ".join(kept) for kept, _ in rows], pa.binary()), pa.string()),
            ], ["doc_id", "n_words", "n_removed", "text"])

    return squeezed(plain).join(lost, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup(read_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH cut AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
    FROM cut, unnest(range(1, len(w) - 48)) AS r(i)),
firsts AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
bad AS (SELECT doc_id, list(i) AS starts FROM windows JOIN firsts USING (h) WHERE lo < doc_id GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(starts) AS i FROM bad), unnest(range(i, i + 50)) AS r(p)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM covered GROUP BY doc_id)
SELECT cut.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string([w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(ps, j)], ' ') END) AS kept_sha256
FROM cut LEFT JOIN gone USING (doc_id)
"""
