"""Helpers of the corpus operators: tables, staged results, word hashes of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.session import delete_folder, shared_dir, ship_package

#: A word is a run of characters other than ASCII white space; ``bytes.split`` cuts the same way.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 2 << 20
CACHE_WORDS = 200_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged results by name; one that is replaced or dropped is deleted from the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._folders = spark, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back; what the name held before goes, once this is written."""
        path = f"{shared_dir(self._spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self._folders[name] = path
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._folders:
                delete_folder(self._spark, self._folders.pop(name))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


_kept: dict[str, tuple] = {}


def kept[T](step: str, key: str, make: Callable[[], T]) -> T:
    """``make()``, kept in the Python worker for the step's next tasks with the same ``key``, until another step's calls ``let_go``."""
    if step not in _kept or _kept[step][0] != key:
        _kept[step] = key, make()
    return _kept[step][1]


def let_go(step: str | None = None) -> None:
    """Frees what the worker keeps for others than ``step``, and what Arrow holds without use.

    Spark's workers outlive their tasks and serve the steps of all queries in turn.
    """
    for name in [x for x in _kept if x != step]:
        del _kept[name]
    pa.default_memory_pool().release_unused()


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES, step: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` has at most ``limit`` bytes (a longer row comes alone).

    A task's start: what the worker keeps for others than ``step`` goes.
    """
    let_go(step)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, total = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > first and total + size > limit:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += size
        if len(sizes) > first:
            yield batch.slice(first)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (one more entry for the end)."""
        parts, starts, get = [], [0], self.__getitem__
        for text in texts:
            words = text.split()
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
            starts.append(starts[-1] + len(words))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(starts, np.int64)


def mix(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def grams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words, as if the words were one text (one per start that fits)."""
    count = max(0, len(words) - n + 1)
    value = np.full(count, (0x9E3779B97F4A7C15 * (seed + n)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + count]
    return mix(value)


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id and ``_text`` with each text compressed, for joins that send all texts through a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in blocks(batches, "_text"):
            small = pa.array([press.compress(x) for x in batch.column("_text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), small], ["doc_id", "_text"])

    return docs.select("doc_id", "_text").mapInArrow(run, "doc_id long, _text binary")


def unsqueezed(column: pa.Array) -> Iterator[bytes]:
    """The texts of a compressed column, one at a time."""
    press = zstandard.ZstdDecompressor()
    for value in column:
        yield press.decompress(value.as_py())
