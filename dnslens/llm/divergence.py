"""How the sources of a language differ in their terms: divergences of all pairs, by row accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnslens.llm.common import LOWER, UPPER, blocks, read_table, staged, text_bytes

#: Documents of a language that a term must be in.
MIN_DOCUMENTS = 3
#: Ranks of terms that are reported for a group.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text that are counted together.
BLOCK_TEXT = 16 << 20
#: Postings of the term-major index in one block, and groups whose rows one task accumulates.
BLOCK_POSTINGS = 2_000_000
ROW_BLOCK = 1024
#: Entries that one step of an accumulation looks at.
STEP = 4_000_000

#: ASCII letters in lower case and all bytes of other letters; other ASCII characters end a term.
_TERMS = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values)))


def count_terms(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts with it) of the terms of texts that belong to numbered groups."""
    order = np.argsort(group, kind="stable")
    texts, group = [texts[k] for k in order.tolist()], group[order]
    joined = np.frombuffer(b" ".join([*texts, b""]).translate(_TERMS), np.uint8)
    inside = np.concatenate([[False], joined != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    offsets = np.append(0, np.cumsum(end - first)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(joined[joined != 32])]).dictionary_encode()
    bounds = np.cumsum([len(x) + 1 for x in texts])
    width = max(1, len(words.dictionary))
    text = np.searchsorted(bounds, first, "right")
    held, often = _distinct(text * width + words.indices.to_numpy())
    text, term = np.divmod(held, width)
    key = group[text] * width + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    owner, term = np.divmod(key[at], width)
    return owner, words.dictionary.take(pa.array(term)), np.add.reduceat(often[order], at) if len(at) else often, np.diff(np.append(at, len(key)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, count, documents: occurrences of each term and documents with it in a group.

    ``docs``: lang, source, _text (bytes). Every block of documents is counted in its task, so a word
    of all documents leaves a block once a group. The counts of a term meet in one partition, by (lang, term),
    where they are added up by group; what follows by (lang, term) needs no other exchange.
    """
    names = ["lang", "source", "term", "count", "documents"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "_text", BLOCK_TEXT):
            places = [batch.column(x).dictionary_encode() for x in ("lang", "source")]
            lang, source = (x.indices.to_numpy() for x in places)
            known = len(places[1].dictionary)
            owner, term, count, documents = count_terms(batch.column("_text").to_pylist(), lang.astype(np.int64) * known + source)
            columns = [places[0].dictionary.take(pa.array(owner // known)), places[1].dictionary.take(pa.array(owner % known)),
                       decoded(term), pa.array(count.astype(np.int64)), pa.array(documents.astype(np.int64))]
            yield from pa.Table.from_arrays(columns, names).to_batches(max_chunksize=200_000)

    parts = docs.mapInArrow(run, "lang string, source string, term string, count long, documents long")
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes of ``column``; larger ones are cut (``blocks``)."""
    held, total = [], 0
    for batch in batches:
        for part in blocks(iter([batch]), column, limit):
            size = part.column(column).nbytes
            if held and total + size > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
            held.append(part)
            total += size
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def decoded(terms: pa.Array) -> pa.Array:
    """Terms as strings; bytes that are no UTF-8 are replaced."""
    try:
        return terms.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in terms.to_pylist()], pa.string())


def _div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, cut down."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """p: the smoothed share of a term in billionths, and one. ``total`` is N + V.

    Three steps of three digits each, so that no product leaves 64 bits.
    """
    rest, out = count + 1, F.lit(0)
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, total)
        rest = rest * 1000 % total
    return out + 1


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    rest, out = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _runs(owner: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, count) and how often each occurs."""
    order = np.lexsort((count, owner))
    owner, count = owner[order], count[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (count[1:] != count[:-1])
    at = np.flatnonzero(new)
    return owner[at], count[at], np.diff(np.append(at, len(owner)))


def accumulate(term: np.ndarray, group: np.ndarray, count: np.ndarray, total: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sums over the terms of a block of f to every group) for each group of ``rows``.

    The block's postings (term, group, count) are the term-major index; ``total`` is N + V of each group.
    A row is gathered as Gustavson's product does: each of its terms is looked up in the index, and what
    stands there is scattered into a dense accumulator with one entry for each group. Terms that
    one side or both lack are corrected from zero baselines: the row starts as if both counts were zero
    throughout, each group's own counts are added once per distinct count against the other's zero share,
    and the postings that both have replace their two one-sided parts.
    """
    groups = len(total)
    order = np.lexsort((group, term))
    term, group, count = term[order], group[order], count[order]
    _, at_term, term = np.unique(term, return_index=True, return_inverse=True)
    begin = np.append(at_term, len(term))
    terms = len(at_term)
    zero = _shares(np.zeros(groups, np.int64), total)
    owner, value, often = _runs(group, count)
    own = _shares(value, total[owner])
    first = np.searchsorted(owner, np.arange(groups + 1))
    share = _shares(count, total[group])
    by_group = np.argsort(group, kind="stable")
    row_begin = np.searchsorted(group[by_group], np.arange(groups + 1))
    held = np.bincount(group, minlength=groups)
    span = np.diff(begin)
    for row in rows.tolist():
        mine = by_group[row_begin[row] : row_begin[row + 1]]
        base = _far(zero[row], zero)
        acc = base * (terms - held[row] - held)
        np.add.at(acc, owner, often * _far(zero[row], own))
        lines = slice(first[row], first[row + 1])
        many = max(1, STEP // groups)
        for k in range(lines.start, lines.stop, many):
            part = slice(k, min(k + many, lines.stop))
            acc += (often[part, None] * _far(own[part, None], zero[None, :])).sum(axis=0)
        length = span[term[mine]]
        ends = np.cumsum(length)
        k = 0
        while k < len(mine):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STEP, "right")))
            some, n = mine[k:stop], length[k:stop]
            at = np.repeat(begin[term[some]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            peer, q, p = group[at], share[at], np.repeat(share[some], n)
            np.add.at(acc, peer, _far(p, q) - _far(p, zero[peer]) - _far(zero[row], q) + base[peer])
            k = stop
        yield row, acc


def pair_sums(index: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: f summed over all kept terms, for every two groups of a language.

    ``index``: lang, term, postings (group, count); ``groups``: lang, source, number (from 0 in its
    language), total (N + V). A language's index is dealt by term into blocks of about ``BLOCK_POSTINGS``
    postings, and its groups into blocks of ``ROW_BLOCK`` rows; a task has one of each. It gives
    one partial sum for each two groups, never one for a shared posting.
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    weight = index.groupBy("lang").agg(F.sum(F.size("postings")).alias("n_postings"))
    plan = sizes.join(weight, "lang", "left").select(
        "lang", F.ceil(F.coalesce("n_postings", F.lit(1)) / BLOCK_POSTINGS).cast("int").alias("term_blocks"),
        F.ceil(F.col("n_groups") / ROW_BLOCK).cast("int").alias("row_blocks"))
    tall = F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb")
    wide = F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("tb")
    left = index.join(plan, "lang").withColumn("tb", F.pmod(F.xxhash64("term"), "term_blocks").cast("int")).select(
        "lang", "tb", tall, F.transform("postings", lambda x: x["number"]).alias("number"),
        F.transform("postings", lambda x: x["count"]).alias("count"))
    right = groups.join(plan, "lang").select("lang", "number", "total", "row_blocks", wide).select("*", tall).drop("row_blocks")

    def run(key: tuple, postings: pa.Table, members: pa.Table) -> pa.Table:
        lang, _, block = (x.as_py() for x in key)
        total = np.ones(len(members), np.int64)
        total[members.column("number").to_numpy()] = members.column("total").to_numpy()
        lists = postings.column("number").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        term = np.repeat(np.arange(len(lengths)), lengths)
        number = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)
        count = postings.column("count").combine_chunks().flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)
        rows = np.arange(block * ROW_BLOCK, min((block + 1) * ROW_BLOCK, len(total)))
        sums = [acc for _, acc in accumulate(term, number, count, total, rows)]
        value = np.concatenate(sums) if sums else np.zeros(0, np.int64)
        a, b = np.repeat(rows, len(total)), np.tile(np.arange(len(total)), len(rows))
        keep = a != b
        return pa.table({"lang": pa.array([lang] * int(keep.sum()), pa.string()), "a": a[keep], "b": b[keep], "value": value[keep]})

    keys = ["lang", "tb", "rb"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others, and by which terms.

    Null texts, languages and sources are empty ones, repeated rows are documents of their own, other
    columns are not carried and may have any name; an empty table gives no rows. A term is a run of ASCII
    letters (in lower case) and non-ASCII characters. A language keeps the terms that
    ``min_documents`` of its documents have. p is a group's share of a term in billionths, smoothed by
    one; f(p, q) = (p - q)^2 / q, cut down. ``pair``: f of the group to another source of the language,
    over all kept terms. ``term``: the group's terms with a larger share than in the language, by f,
    up to rank ``top_terms``. Ranks go by value, then by item; whole numbers throughout.
    """
    plain = docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias) for name, alias in ((lang, "lang"), (source, "source"))],
                        text_bytes(text).alias("_text"))
    kept = term_counts(plain).groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("in_lang"),
                                              F.collect_list(F.struct("source", "count")).alias("postings"))
    index = staged(kept.filter(F.col("documents") >= min_documents).drop("documents"))
    flat = index.select("lang", "term", "in_lang", F.inline("postings"))
    vocabulary = index.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    own = flat.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = staged(plain.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left").select(
        "lang", "source", number.alias("number"), (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
        (F.col("n_lang") + F.col("v")).alias("lang_total")))
    # Groups without kept terms in a language without any have no shares: every sum is over nothing.
    numbered = flat.join(groups.select("lang", "source", "number"), ["lang", "source"]).groupBy("lang", "term").agg(
        F.collect_list(F.struct("number", "count")).alias("postings"))
    sums = pair_sums(numbered, groups.withColumn("total", F.greatest("total", F.lit(1))))
    names = groups.select("lang", "source", "number")
    pairs = sums.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("source").alias("item"), F.col("number").alias("b")), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    shares = flat.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).withColumn(
        "p", share(F.col("count"), F.col("total"))).withColumn("q", share(F.col("in_lang"), F.col("lang_total"))).filter("p > q")
    terms = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                          _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top_terms))


def op11_source_divergence_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Divergences of all (lang, source) groups of the documents."""
    return divergences(read_table(spark, folder, "documents"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
vocabulary AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang),
sizes AS (
    SELECT lang, source, coalesce(sum(counts.c), 0)::BIGINT AS n FROM groups
    LEFT JOIN (SELECT counts.* FROM counts JOIN kept USING (lang, term)) counts USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (s.n + v.v) AS p,
           1 + 1000000000 * (k.c + 1) // (v.n + v.v) AS q
    FROM sizes s JOIN kept k USING (lang) JOIN vocabulary v USING (lang)
    LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE c > 0 AND p > q)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
