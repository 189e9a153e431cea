"""What Python workers keep between the tasks of different steps."""

from __future__ import annotations

import gc
import weakref

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StructField, StructType

from dnslens.llm import bpe, near, toxicity


class Frame:
    """A frame whose ``mapInArrow`` gives the function, to be run here as a worker does."""

    schema = None

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


class Texts(Frame):
    """Stands for documents and what is selected of them."""

    schema = StructType([StructField("_key", LongType())])

    def select(self, *columns):
        return self


def task(run, **columns) -> list[dict]:
    batches = iter([pa.RecordBatch.from_pydict(columns)])
    return [row for out in run(batches) for row in out.to_pylist()]


def toxic_step(monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda *_, **__: toxicity.Chain([], {}, []))
    monkeypatch.setattr(toxicity.Chain, "probabilities", lambda *_: [0.0])
    run = toxicity.without_toxic(Texts(), None)
    return lambda: task(run, text=["some words"])


STEPS = {
    "toxicity": toxic_step,
    "signatures": lambda _: lambda: task(near.signatures(Frame(), 4), doc_id=[1], _text=[b"some words"]),
    "sets": lambda _: lambda: task(near.shingle_sets(Frame(), 4, False), doc_id=[1], _text=[b"some words"]),
}


@pytest.mark.parametrize("step", STEPS)
def test_coder_goes_with_its_step(spark, monkeypatch, step):
    """The coder stays for the tasks of its own step; the first task of another step frees it."""
    work, path = STEPS[step](monkeypatch), bpe.default_path()
    coder = weakref.ref(bpe.word_bpe(path))
    coder().encode("some words")
    own = bpe._map_texts(Texts(), "doc_id", "text", path, "ids array<int>", lambda c, x: [c.encode(x)])
    assert task(own, _key=[1], _text=[b"some words"])[0]["ids"] and bpe.word_bpe(path) is coder()
    assert len(work()) == 1
    gc.collect()
    assert coder() is None
