"""Toxicity: a chain of linear classifiers over words and word beginnings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import blocks, read_table, staged, text_bytes

#: Labelled texts the models are fitted on at most (those with the least hash of their id), and features a category takes.
SAMPLE, FEATURES = 20_000, 5_000
#: A feature must stand in so many labelled texts, and deviate by so many standard deviations.
LEAST_TEXTS, LEAST_Z = 3, 4.0
FOLDS = 3
THRESHOLD = 0.4
PREFIXES = (4, 5, 6, 7)
EDGES = ".,!?;:\"'()[]{}|<>*%#…«»"
CACHE_WORDS = 150_000

#: The chain, in order: name -> label column (1 yes, 0 no, null unknown).
CHAIN: dict[str, Column | str] = {"low_quality": "1 - quality", "toxic": "toxic"}


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    bare = word.strip(EDGES)
    if not bare:
        return []
    names = [bare, *[bare[:n] + "*" for n in PREFIXES if len(bare) >= n]]
    return [xxhash.xxh64_intdigest(name.encode()) - (1 << 63) for name in names]


def shape(text: str, words: list[str]) -> list[float]:
    """Shares of capital words, column bars and distinct words (all 0 without words)."""
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0]
    return [sum(map(str.isupper, words)) / n, text.count(" | ") / n, len(set(words)) / n]


SHAPES = 3


@dataclass
class Linear:
    """Logistic regression: a weight per feature, then the shapes, the earlier probabilities and a constant."""

    words: np.ndarray
    dense: np.ndarray

    def probability(self, features: np.ndarray, dense: np.ndarray) -> float:
        score = float(self.words[features].sum() + dense @ self.dense[:-1] + self.dense[-1])
        return float(1 / (1 + np.exp(-np.clip(score, -40, 40))))


def fit_linear(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, steps: int = 80,
               l2: float = 1e-4) -> Linear:
    """Fitted by accelerated gradient steps over (row, column) pairs of present features and dense columns."""
    n = len(y)
    base = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    words, flat = np.zeros(width), np.zeros(dense.shape[1] + 1)
    flat[-1] = np.log(base / (1 - base))
    if not n or y.min() == y.max():
        return Linear(words, flat)
    full = np.hstack([dense, np.ones((n, 1))])
    # a step per column, from how often it is set: rare features learn as fast as common ones
    seen = np.bincount(columns, minlength=width)
    rate = 8.0 / np.maximum(seen, 1) / np.sqrt(np.maximum(np.bincount(rows, minlength=n).max(initial=1), 1))
    flat_rate = 2.0 / np.maximum((full**2).sum(0), 1e-9)
    fast_w, fast_d, last_w, last_d = words.copy(), flat.copy(), words.copy(), flat.copy()
    for step in range(steps):
        score = np.bincount(rows, fast_w[columns], n) + full @ fast_d
        error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - y
        words = fast_w - rate * (np.bincount(columns, error[rows], width) + l2 * n * fast_w / FOLDS)
        flat = fast_d - flat_rate * (full.T @ error)
        pace = step / (step + 3)
        fast_w, fast_d = words + pace * (words - last_w), flat + pace * (flat - last_d)
        last_w, last_d = words, flat
    return Linear(words, flat)


def _dot(model: Linear, rows, columns, dense) -> np.ndarray:
    n = len(dense)
    score = np.bincount(rows, model.words[columns], n) + dense @ model.dense[:-1] + model.dense[-1]
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def fit_chain(rows: np.ndarray, columns: np.ndarray, shapes: np.ndarray, labels: np.ndarray, folds: np.ndarray, width: int) -> list[Linear]:
    """One model per category; each gets the earlier ones' probabilities, out of fold while it is fitted.

    ``labels``: a column per category, NaN where unknown. An unlabelled row is not used for that category,
    but gets its probability for the next one.
    """
    dense, models = shapes, []
    for y in labels.T:
        known = ~np.isnan(y)

        def fitted(use: np.ndarray) -> Linear:
            keep = use[rows]
            place = np.cumsum(use) - 1
            return fit_linear(place[rows[keep]], columns[keep], dense[use], y[use], width)

        out = np.zeros(len(y))
        for fold in range(FOLDS):
            inside = folds == fold
            model = fitted(known & ~inside)
            out[inside] = _dot(model, rows, columns, dense)[inside]
        models.append(fitted(known))
        dense = np.hstack([dense, out[:, None]])
    return models


@dataclass
class Chain:
    names: list[str]
    index: dict[int, int]
    models: list[Linear]

    def probabilities(self, features: np.ndarray, dense: list[float]) -> list[float]:
        known = list(dense)
        out: list[float] = []
        for model in self.models:
            out.append(model.probability(features, np.array(known)))
            known.append(out[-1])
        return out


class _Known(dict):
    """Word -> places of its selected features, for a bounded number of words."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        get = self.index.get
        value = self[word] = tuple([i for i in map(get, word_features(word)) if i is not None])
        return value


def _found(known: _Known, text: str) -> tuple[np.ndarray, list[float]]:
    words = text.split()
    features = {i for word in set(text.lower().split()) for i in known[word]}
    return np.fromiter(features, np.int64, len(features)), shape(text, words)


def labelled_sample(docs: DataFrame, labels: DataFrame, chain: dict, size: int) -> DataFrame:
    """doc_id, _text, a column per category: at most ``size`` labelled documents, equal texts once."""
    rows = labels.select(F.col("doc_id"), *[(F.expr(x) if isinstance(x, str) else x).cast("double").alias(n) for n, x in chain.items()])
    rows = rows.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(n).alias(n) for n in chain])
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    found = docs.join(F.broadcast(picked), "doc_id")
    return found.groupBy("_text").agg(F.min("doc_id").alias("doc_id"), *[F.max(n).alias(n) for n in chain])


def _count_features(sample: DataFrame, names: list[str]) -> DataFrame:
    """feature, n (texts), and per category the labelled and positive texts that hold it."""
    columns = ["n", *[f"{kind}_{name}" for name in names for kind in ("of", "yes")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in columns]
        memory: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(counts[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[pa.array([c[k] for k in keys], pa.int64()) for c in counts]], ["feature", *columns])

        for batch in blocks(batches, "_text"):
            marks = [batch.column(name).to_pylist() for name in names]
            for i, text in enumerate(batch.column("_text").to_pylist()):
                features = set()
                for word in set(text.decode("utf-8", "replace").lower().split()):
                    if word not in memory:
                        if len(memory) >= CACHE_WORDS // 2:
                            memory.clear()
                        memory[word] = word_features(word)
                    features.update(memory[word])
                counts[0].update(features)
                for k, mark in enumerate(marks):
                    if mark[i] is not None:
                        counts[1 + 2 * k].update(features)
                        if mark[i] > 0:
                            counts[2 + 2 * k].update(features)
            if len(counts[0]) > 150_000:
                yield out()
                counts = [Counter() for _ in columns]
        yield out()

    schema = "feature long, " + ", ".join(f"{c} long" for c in columns)
    return sample.mapInArrow(run, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns])


def _select_features(sample: DataFrame, names: list[str], most: int) -> list[int]:
    counts = staged(_count_features(sample, names).filter(F.col("n") >= LEAST_TEXTS))
    rates = sample.agg(*[F.avg(name).alias(name) for name in names]).first()
    chosen: set[int] = set()
    for name in names:
        p = rates[name]
        if p is None or not 0 < p < 1:
            continue
        z = (F.col(f"yes_{name}") - F.col(f"of_{name}") * p) / F.sqrt(F.greatest("n", F.lit(1)) * p * (1 - p))
        best = counts.withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(most)
        chosen.update(r.feature for r in best.select("feature").collect())
    return sorted(chosen)


def fit(docs: DataFrame, labels: DataFrame, chain: dict | None = None, size: int = SAMPLE, most: int = FEATURES) -> Chain:
    """The chain of models, fitted on a bounded sample of the labelled documents.

    ``docs``: doc_id, _text (bytes). What comes to the driver is bounded: at most ``most`` features a
    category, and for each of at most ``size`` texts its shapes and which of those features it holds.
    Without labels, or with labels of one kind only, a model gives the labels' rate (0.001 to 0.999).
    """
    chain = CHAIN if chain is None else chain
    names = list(chain)
    sample = staged(labelled_sample(docs, labels, chain, size))
    features = _select_features(sample, names, most)
    index = {feature: i for i, feature in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(index)
        for batch in blocks(batches, "_text"):
            rows = [_found(known, x.decode("utf-8", "replace")) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[batch.column(n) for n in names],
                pa.array([f.tolist() for f, _ in rows], pa.list_(pa.int32())), pa.array([s for _, s in rows], pa.list_(pa.float64())),
            ], ["doc_id", *names, "features", "shapes"])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", features array<int>, shapes array<double>"
    table = sample.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    held = table.column("features").combine_chunks()
    lengths = np.array([len(x) for x in held], np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    columns = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    shapes = table.column("shapes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPES)
    known = np.array([table.column(n).to_numpy() for n in names], float).T.reshape(-1, len(names))
    ids = table.column("doc_id").to_pylist()
    folds = np.array([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in ids], np.int64)
    return Chain(names, index, fit_chain(rows, columns, shapes, known, folds, len(features)))


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, p_<category> for each of the chain, toxic (the last one's probability is ``threshold`` or more).

    Whole texts are read; null and empty ones hold no feature. Rows are independent: repeated rows give
    repeated results, other columns are not carried, an empty table gives none.
    """
    columns = [f"p_{name}" for name in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(chain.index)
        for batch in blocks(batches, "_text"):
            rows = [chain.probabilities(*_found(known, x.decode("utf-8", "replace"))) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(len(columns))],
                 pa.array([r[-1] >= threshold for r in rows], pa.bool_())], [key, *columns, "toxic"])

    plain = docs.select(F.col(key).alias("_key"), "_text")
    kind = plain.schema["_key"].dataType.simpleString()
    return plain.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} double" for c in columns) + ", toxic boolean")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """Fits on the labelled part of ``docs`` and scores all of it; ``options`` go to ``fit``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("_text"))
    return score(plain, fit(plain, labels, **options))


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not hold to be toxic; null and empty texts stay."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("_text"))
    chain = fit(plain, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(chain.index)
        for batch in blocks(batches, text):
            scores = [chain.probabilities(*_found(known, x or ""))[-1] for x in batch.column(text).to_pylist()]
            yield batch.filter(pa.array([p < threshold for p in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
