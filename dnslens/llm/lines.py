"""Line dedup: a fixed-depth tree of line templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import read_table, staged
from dnslens.session import broadcast_if_small

#: Leading tokens that lead to a leaf, after the token count.
DEPTH = 3
#: A template recurs from so many unrelated documents on.
MIN_DOCUMENTS = 10
#: Leaves are broadcast up to this number (8 bytes each); more are joined by shuffling.
BROADCAST_LEAVES = 200_000
WILD = "<*>"


def _sentence_digests(text: Column) -> Column:
    sentences = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(sentences, lambda s: F.md5(s))


def _families(digests: Column) -> tuple[Column, Column]:
    """Two marks that copies and edited copies of a text mostly share: its sentences' least digests, by either half."""
    return (F.array_min(F.transform(digests, lambda d: F.substring(d, 1, 16))),
            F.array_min(F.transform(digests, lambda d: F.substring(d, 17, 16))))


def _masked(tokens: Column) -> Column:
    """Tokens with a digit are variable fields."""
    return F.transform(tokens, lambda token: F.when(token.rlike("[0-9]"), F.lit(WILD)).otherwise(token))


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), _masked(F.slice(tokens, 1, DEPTH)))


def _exploded(docs: DataFrame, *carried: str) -> DataFrame:
    lines = docs.select("row", *carried, F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    tokens = lines.select("row", "pos", *carried, F.split(F.trim("line"), " +").alias("tokens"), F.col("line").rlike("[0-9]").alias("digits"))
    return tokens.filter(F.size("tokens") >= DEPTH).withColumn("leaf", _leaf(F.col("tokens")))


def _own() -> Column:
    """The tokens of a line, masked; most lines hold no digit and need no look at each token."""
    return F.when(F.col("digits"), _masked(F.col("tokens"))).otherwise(F.col("tokens"))


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """row, pos of the lines whose template recurs. ``docs``: row (a hash that equal rows share), _text.

    The tree sends a line by its token count and its first tokens to a leaf; tokens with digits are
    variable fields from the start. In a leaf that enough documents reach, the token that most of its
    lines have at a place is constant there, and the others are variable fields: lines that agree with
    at least half of the constants behind the leading tokens share the leaf's template. Other lines are
    templates of their own. A template recurs if ``min_documents`` documents that are no copies of each
    other hold it, and these are at least half of all that do: lines that only the copies of one text
    share are left to the near-duplicate stage, which sees the whole texts.
    """
    one, two = _families(F.col("digests"))
    # the digests are a column of their own, so that they are made once for both marks
    marked = docs.withColumn("digests", _sentence_digests(F.col("_text"))).select("row", "_text", one.alias("one"), two.alias("two"))
    lines = staged(_exploded(marked, "one", "two").select(
        "row", "pos", F.xxhash64("one").alias("one"), F.xxhash64("two").alias("two"), "leaf", F.xxhash64(_own()).alias("own")))
    reached = lines.groupBy("leaf").agg(F.count_distinct("row").alias("docs")).filter(F.col("docs") >= min_documents)
    frequent = broadcast_if_small(staged(reached.select("leaf")), BROADCAST_LEAVES)
    hashed = _exploded(docs).join(frequent, "leaf").select("leaf", _own().alias("tokens")).select(
        "leaf", F.xxhash64("tokens").alias("own"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))
    distinct = staged(hashed.groupBy("leaf", "own").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    totals = distinct.groupBy("leaf").agg(F.sum("n").alias("total"))
    places = distinct.select("leaf", "n", F.posexplode("tokens").alias("place", "token")).filter(F.col("place") >= DEPTH)
    counted = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"))
    constant = counted.join(totals, "leaf").filter(2 * F.col("n") > F.col("total"))
    constants = constant.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("constants"))
    agree = F.size(F.filter(F.map_entries("constants"), lambda e: F.get(F.col("tokens"), e["key"]) == e["value"]))
    rest = F.size("tokens") - DEPTH
    shared = (rest > 0) & (2 * F.coalesce(agree, F.lit(0)) >= rest)
    templates = distinct.join(constants, "leaf", "left").select(
        "leaf", "own", F.when(shared, F.col("leaf")).otherwise(F.col("own")).alias("template"), shared.alias("is_leaf"))
    held = staged(lines.join(templates, ["leaf", "own"]).select("row", "pos", "template", "is_leaf", "one", "two"))
    counts = held.groupBy("template", "is_leaf").agg(
        F.count_distinct("row").alias("docs"), F.count_distinct("one").alias("one"), F.count_distinct("two").alias("two"))
    unrelated = F.greatest("one", "two")
    again = counts.filter((unrelated >= min_documents) & (2 * unrelated >= F.col("docs"))).select("template", "is_leaf")
    return held.join(again, ["template", "is_leaf"]).select("row", "pos")


def drop_recurring(docs: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and its counts as ``_n_lines``, ``_n_dropped``.

    All rows and columns stay. A null text stays null, an empty one empty, with no lines; a text of which
    every line goes becomes empty. Blank lines and lines of fewer than three tokens are kept. Repeated
    rows count as one document and are treated alike, as are rows with a null id. An empty table gives none.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.xxhash64("doc_id", value)
    plain = docs.select(key.alias("row"), value.alias("_text"))
    dropped = recurring_lines(plain, min_documents).groupBy("row").agg(F.collect_set("pos").alias("_gone"))
    gone = dropped.select(F.col("row").alias("_dedup_row"), F.col("_gone").alias("_dedup_gone"))
    joined = docs.withColumn("_dedup_key", key).join(gone, F.col("_dedup_key") == F.col("_dedup_row"), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_dedup_gone", i)), "\n")
    count = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(lines))
    return joined.withColumns({
        "_n_lines": count.cast("long"),
        "_n_dropped": F.coalesce(F.size("_dedup_gone"), F.lit(0)).cast("long"),
        text: F.when(F.col("_dedup_gone").isNull(), F.col(text)).otherwise(kept),
    }).drop("_dedup_key", "_dedup_row", "_dedup_gone")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that is left."""
    docs = drop_recurring(read_table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents),
sentences AS (
    SELECT doc_id, md5(trim(s)) AS d FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM docs) WHERE trim(s) <> ''),
families AS (SELECT doc_id, min(substr(d, 1, 16)) AS one, min(substr(d, 17)) AS two FROM sentences GROUP BY doc_id),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (
    SELECT doc_id, pos, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN regexp_split_to_array(trim(ls[pos], ' '), ' +')] AS w
    FROM cut, unnest(range(1, len(ls) + 1)) AS r(pos)),
leaves AS (SELECT *, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf FROM lines WHERE len(w) >= 3),
reached AS (SELECT leaf, count(*) AS total FROM leaves GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
places AS (
    SELECT leaf, p, w[p] AS token, count(*) AS n FROM leaves JOIN reached USING (leaf), unnest(range(4, len(w) + 1)) AS r(p) GROUP BY ALL),
constants AS (SELECT leaf, p, token FROM places JOIN reached USING (leaf) WHERE 2 * n > total),
agreeing AS (
    SELECT doc_id, pos, count(*) AS n FROM leaves l JOIN constants c ON c.leaf = l.leaf AND l.w[c.p] = c.token GROUP BY ALL),
templates AS (
    SELECT doc_id, pos, CASE WHEN len(w) > 3 AND 2 * coalesce(n, 0) >= len(w) - 3 THEN 'leaf ' || leaf ELSE 'line ' || array_to_string(w, ' ') END AS template
    FROM leaves JOIN reached USING (leaf) LEFT JOIN agreeing USING (doc_id, pos)),
recurring AS (
    SELECT template FROM templates JOIN families USING (doc_id) GROUP BY template
    HAVING greatest(count(DISTINCT one), count(DISTINCT two)) >= 10
       AND 2 * greatest(count(DISTINCT one), count(DISTINCT two)) >= count(DISTINCT doc_id)),
gone AS (SELECT doc_id, list(pos) AS ps FROM templates JOIN recurring USING (template) GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(ls) = 1 AND ls[1] = '' THEN 0 ELSE len(ls) END AS n_lines, coalesce(len(ps), 0) AS n_dropped,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(ls, chr(10))
              ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(ps, i)], chr(10)) END) AS text_sha256
FROM cut LEFT JOIN gone USING (doc_id)
"""
