"""URL filters: rules indexed by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import lower_ascii, read_table

#: (host, path, verdict)
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: (literal tokens, pattern) of rules for hosts and paths that no host rule covers; all of them block.
#: A literal token is one that stands between separators in every text that the pattern fits.
WORD_RULES = [
    (["casino"], r"(^|[^a-z0-9])casino([^a-z0-9]|\z)"),
    (["casinos"], r"(^|[^a-z0-9])casinos([^a-z0-9]|\z)"),
    (["bets"], r"(^|[^a-z0-9])(free|best|sure)-bets([^a-z0-9]|\z)"),
    (["pills"], r"(^|[^a-z0-9])(cheap|diet)-pills([^a-z0-9]|\z)"),
    (["viagra"], r"(^|[^a-z0-9])viagra([^a-z0-9]|\z)"),
    (["porn"], r"(^|[^a-z0-9])porn([^a-z0-9]|\z)"),
    (["xxx"], r"(^|[^a-z0-9])xxx([^a-z0-9]|\z)"),
    (["warez"], r"(^|[^a-z0-9])warez([^a-z0-9]|\z)"),
    (["wp", "login", "php"], r"/wp-login\.php\z"),
]
#: Rules are broadcast only up to this number; more are joined by shuffling.
BROADCAST_RULES = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def tokens(text: Column) -> Column:
    """The distinct literal tokens (runs of letters and digits, lower-cased)."""
    cut = F.split(lower_ascii(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(cut, lambda token: token != ""))


def rule_table(spark: SparkSession, host_rules=None, word_rules=None) -> DataFrame:
    """Rules as rows: name (null for word rules), pattern over ``host + path``, verdict, literal tokens, rank.

    A host rule's pattern is its host at the start or after a dot, the end of the host (marked by a
    newline, which a host rule cannot hold), and the start of its path. The longest rule ranks first.
    """
    rows = []
    for host, path, verdict in HOST_RULES if host_rules is None else host_rules:
        # the path's last token may go on in the URL, unless a separator ends it
        literal = [x for x in re.split("[^a-z0-9]+", host.lower()) + re.split("[^a-z0-9]+", path.lower())[:-1] if x]
        pattern = rf"^([^\n]*\.)?{re.escape(host)}\n{re.escape(path)}"
        rows.append((host + path, pattern, verdict, literal, len(host + path)))
    for literal, pattern in WORD_RULES if word_rules is None else word_rules:
        rows.append((None, pattern, "block", literal, -1))
    schema = "rule string, pattern string, verdict string, literals array<string>, rank int"
    return spark.createDataFrame(rows, schema)


def index_rules(rules: DataFrame, urls: DataFrame, url_tokens: str = "tokens") -> DataFrame:
    """Rules with ``token``: of their literal tokens the one that fewest URLs hold.

    Counts are taken over all URLs, for tokens that rules name only; ties go to the longer,
    then the smaller token. A rule without any literal token is kept under the empty token,
    which every URL is given, so that no rule is lost.
    """
    named = rules.select(F.explode("literals").alias("token")).distinct()
    seen = urls.select(F.explode(url_tokens).alias("token")).join(F.broadcast(named), "token")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    options = rules.select("*", F.explode_outer("literals").alias("token"))
    ranked = options.join(F.broadcast(counts), "token", "left").groupBy("rule", "pattern", "verdict", "rank").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token")).alias("token")
    )
    return ranked.withColumn("token", F.coalesce("token", F.lit("")))


def judge(urls: DataFrame, rules: DataFrame | None = None, url: str = "url", key: str = "page_id") -> DataFrame:
    """Verdict per URL: ``key``, host, path, rule, verdict, word_rules.

    Each URL's tokens fetch the rules indexed under them; only those run their pattern. The longest
    host rule that fits decides and is named; else any word rule blocks and ``rule`` is null; else the
    URL is allowed. Null and empty URLs, and those without ``://``, have empty host and path and are
    allowed. Repeated rows are judged each; other columns are not carried. An empty table gives none.

    The candidate join multiplies a URL's row by the rules under its tokens only, and results are
    folded per row again before they leave the task: no URL is shuffled while the rules are few enough
    to broadcast. More than ``BROADCAST_RULES`` rules are joined by token with a shuffle.
    """
    spark = urls.sparkSession
    rules = rule_table(spark) if rules is None else rules
    host, path = host_and_path(F.col(url))
    parts = urls.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("tokens", tokens(F.concat_ws("/", "host", "path")))
    indexed = index_rules(rules, parts)
    target = F.concat("host", F.lit("\n"), "path")
    plain = lower_ascii(F.concat("host", "path"))
    rule = F.struct("rank", "rule", "pattern", "verdict")
    by_token = indexed.groupBy("token").agg(F.collect_list(rule).alias("candidates"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        table = by_token.agg(F.map_from_entries(F.collect_list(F.struct("token", "candidates"))).alias("index"))
        fetched = parts.withColumn("index", table.scalar()).select(
            "page_id", "host", "path",
            F.flatten(F.transform(
                F.filter(F.array_append("tokens", F.lit("")), lambda token: F.map_contains_key("index", token)),
                lambda token: F.col("index")[token],
            )).alias("candidates"),
        )
    else:
        row = parts.withColumn("row", F.monotonically_increasing_id())
        each = row.select("*", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
        fetched = each.join(by_token, "token", "left").groupBy("row", "page_id", "host", "path").agg(
            F.flatten(F.collect_list("candidates")).alias("candidates"))
    fits = F.filter("candidates", lambda c: F.when(c["rank"] >= 0, F.rlike(target, c["pattern"])).otherwise(F.rlike(plain, c["pattern"])))
    best = F.array_max(F.transform("fits", lambda c: F.struct(c["rank"], c["rule"], c["verdict"])))
    return (
        fetched.select("page_id", "host", "path", fits.alias("fits"))
        .select("page_id", "host", "path", best.alias("best"),
                F.size(F.filter("fits", lambda c: c["rank"] < 0)).alias("word_rules"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), "word_rules")
    )


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read_table(spark, folder, "pages"))


_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in HOST_RULES)
SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut),
hosts AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM parts),
rules(rhost, rpath, rverdict) AS (VALUES {_RULES}),
fits AS (
    SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
           arg_max(rverdict, length(rhost || rpath)) AS rverdict
    FROM hosts, rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY page_id),
words AS (
    SELECT *, {" + ".join(f"CAST(regexp_matches(target, '{pattern}') AS INT)" for _, pattern in WORD_RULES)} AS word_rules
    FROM (SELECT *, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM hosts))
SELECT w.page_id, w.host, w.path, f.rule,
       coalesce(f.rverdict, CASE WHEN w.word_rules > 0 THEN 'block' ELSE 'allow' END) AS verdict, w.word_rules
FROM words w LEFT JOIN fits f ON w.page_id = f.page_id
"""
