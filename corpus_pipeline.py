"""The corpus pipeline: documents in, encoded documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.bpe import digests
from dnslens.llm.common import read_table, staged
from dnslens.llm.decontamination import leaks
from dnslens.llm.lines import drop_recurring
from dnslens.llm.near import near_duplicates
from dnslens.llm.toxicity import without_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain, fitted on the labelled ones among them, does not reject."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs. n_chars is that of the text that is left."""
    out = drop_recurring(docs)
    if "n_chars" in docs.columns:
        length = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def single_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; rows without an id stay."""
    found = near_duplicates(docs)
    return docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; rows without an id stay."""
    found = leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return digests(docs)


STAGES = [
    ("toxicity", clean),
    ("line dedup", unrepeated_lines),
    ("near dedup", single_copies),
    ("decontamination", uncontaminated),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier, alignment and encoder cannot be said in SQL; the tests run a brute-force version.
ORACLE_SQL = None
