"""Document fingerprints: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dnslens.llm.common import WORD_BREAK, read_table
from dnslens.session import broadcast_if_small

SHINGLE = 5
#: One hash in so many is retained.
SCALE = 8
#: Ranges of keys (by quantiles) that documents are dealt into to find each one's successor, and documents
#: that one should hold: ranges with more are cut into as many parts of equal width as the table needs.
RANGES, RANGE_DOCUMENTS = 256, 20_000
#: Ranges whose first ids are broadcast (16 bytes each).
BROADCAST_RANGES = 100_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text (null: none)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda word: word != "")
    return F.transform(words, lambda word: F.xxhash64(word))


def shingle_hashes(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; fewer words are one run, none give an empty array."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - size + 1),
        lambda i: F.xxhash64(*[F.get(hashes, i + k - 1) for k in range(size)]),
    )
    return F.when(F.size(hashes) >= size, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(
        F.array().cast("array<bigint>"))


def retained(shingles: Column, scale: int = SCALE) -> Column:
    """The sketch: distinct hashes below 1/``scale`` of the range, sorted; if there are none, the least hash.

    Sketches merge: the union's hashes below the bound, else its least one, are in the parts' sketches.
    """
    bound = -(1 << 63) + (1 << 64) // scale
    low = F.filter(shingles, lambda h: h < F.lit(bound).cast("long"))
    least = F.when(F.size(shingles) > 0, F.array(F.array_min(shingles))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(least)


def merged(left: Column, right: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together, from their sketches."""
    return retained(F.array_union(left, right), scale)


def likeness(left: Column, right: Column) -> Column:
    """Estimate of the shared part of the union (1 if both are empty)."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(part: Column, whole: Column) -> Column:
    """Estimate of the share of ``part`` that ``whole`` holds, however unequal their sizes (1 for an empty part)."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def as_text(sketch: Column) -> Column:
    """The sketch as text, 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_sketch(df: DataFrame, text: str, sketch: str, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of a text column. Each step is a column of its own, so none is worked out per element."""
    return (
        df.withColumn("_hashes", word_hashes(F.col(text)))
        .withColumn("_shingles", shingle_hashes(F.col("_hashes"), size))
        .withColumn(sketch, retained(F.col("_shingles"), scale))
        .drop("_hashes", "_shingles")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``key``, n_chars, sketch, fingerprint of every whole text.

    Null and empty texts, and those of white space only, have an empty sketch. Rows are independent:
    repeated ones give repeated results; other columns are not carried and may have any name; an empty
    table gives none. Equal texts have equal fingerprints.
    """
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    marked = with_sketch(plain, "_text", "sketch", size, scale)
    return marked.select(key, F.length("_text").cast("long").alias("n_chars"), "sketch", as_text(F.col("sketch")).alias("fingerprint"))


def _dealt(docs: DataFrame, ranges: int, documents: int) -> DataFrame:
    """``docs`` with ``_range``, which rises with doc_id; null ids have none."""
    marks = [i / ranges for i in range(ranges + 1)]
    bounds, count = docs.agg(F.percentile_approx("doc_id", marks, 10_000), F.count("doc_id")).first()
    if not count:
        return docs.withColumn("_range", F.lit(None).cast("long"))
    steps = sorted(set(bounds))
    parts = max(1, -(-count // (documents * ranges)))
    table, key = F.array(*[F.lit(x) for x in steps]), F.col("doc_id")
    place = F.greatest(F.size(F.filter(table, lambda x: x <= key)), F.lit(1))
    low = F.element_at(table, place).cast("double")
    width = F.element_at(table, F.least(place + 1, F.lit(len(steps)))).cast("double") - low + 1
    part = F.floor((key.cast("double") - low) / width * parts)
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))  # quantiles are approximate at the ends
    return docs.withColumn("_range", F.when(key.isNotNull(), place.cast("long") * parts + inside))


def with_next(docs: DataFrame, carried: list[str], ranges: int = RANGES, documents: int = RANGE_DOCUMENTS) -> DataFrame:
    """``next``: struct of the ``carried`` columns of the document that follows in descending doc_id, cyclically.

    Documents are dealt into ranges of doc_id (at most ``ranges`` + 1 bounds come to the driver), their
    number growing with the table, and follow each other within a range by a window; each range also gets
    a copy of the first row of the range below it, so the text moves once. What is gathered in one place
    is one number per range. Repeated ids follow each other by the hash of the carried columns. Rows
    without an id are a range of their own, whose last row has no next.
    """
    dealt = _dealt(docs, ranges, documents)
    heads = dealt.filter("doc_id is not null").groupBy("_range").agg(F.max("doc_id").alias("head"))
    # the highest range's first row follows the lowest range
    lowest = heads.agg(F.min("_range")).scalar()
    above = F.coalesce(F.lead("_range").over(W.orderBy("_range")), lowest)
    copies = broadcast_if_small(heads.select(F.col("head").alias("_head"), above.alias("_to")), BROADCAST_RANGES)
    extra = dealt.join(copies, F.col("doc_id") == F.col("_head")).withColumn("_range", F.col("_to")).drop("_head", "_to")
    both = dealt.withColumn("_copy", F.lit(False)).unionByName(extra.withColumn("_copy", F.lit(True)))
    order = W.partitionBy("_range").orderBy("_copy", F.desc("doc_id"), F.xxhash64(*carried))
    return both.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter(~F.col("_copy")).drop("_copy", "_range")


def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    following = with_next(with_sketch(docs, "text", "sketch"), ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"),
                      F.coalesce(F.substring("next.text", F.lit(1), half), F.lit("")))
    plain = following.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch",
                             F.col("next.sketch").alias("next_sketch"))
    done = with_sketch(plain, "edited", "edited_sketch")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
