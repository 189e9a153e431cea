"""Every operator on null, empty, long, repeated and tied rows, on empty tables, with clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dnslens.llm import bpe, chat, decontamination, fingerprints, licences, lines, near, substrings, toxicity, urls

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "alpha"), (None, "x y z w v")],
                                      "item_id long, text string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 1)], LABELS)
    return benchmark, labels


def operators(benchmark, labels):
    return {
        "lines": lambda d: lines.drop_recurring(d),
        "bpe": lambda d: bpe.digests(d),
        "encode": lambda d: bpe.encode(d),
        "fingerprints": lambda d: fingerprints.fingerprints(d),
        "licences": lambda d: licences.scan(d),
        "toxicity": lambda d: toxicity.classify(d, labels),
    }


@pytest.mark.parametrize("name", sorted(operators(None, None)))
def test_one_result_per_row(edges, edge_rows, tables, name):
    run = operators(*tables)[name]
    assert run(edges).count() == len(edge_rows)
    assert run(edges.limit(0)).count() == 0


def test_lines_keep_rows_and_columns(edges):
    out = lines.drop_recurring(edges)
    assert set(edges.columns) < set(out.columns)
    assert out.filter("text is null").count() == 2
    assert out.filter("_n_dropped > 0").count() == 0


def test_bpe_of_nothing(edges):
    rows = {r.doc_id: r for r in bpe.digests(edges).filter("doc_id in (1, 2, 3)").collect()}
    assert {r.n_tokens for r in rows.values()} == {0}
    assert len({r.decoded_sha256 for r in rows.values()}) == 1


def test_licences_of_nothing(edges):
    rows = licences.scan(edges).filter("doc_id in (1, 2, 3)").collect()
    assert {(r.license, r.notices, r.notice_lines) for r in rows} == {(None, "", 0)}


def test_substrings(edges, edge_rows):
    rows = substrings.dedup(edges, window=4, size=2).collect()
    assert len(rows) == len(edge_rows)
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id == 6} == {(10, 10)}
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id == 5} == {(10, 0)}
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert [r.n_removed for r in rows if r.doc_id is None] == [0, 0]
    assert substrings.dedup(edges.limit(0)).count() == 0


def test_near(edges, edge_rows):
    rows = near.near_duplicates(edges).collect()
    assert len(rows) == len([x for x in edge_rows if x[0] is not None])
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (5, 6)} == {(5, 5), (6, 5)}
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert near.near_duplicates(edges.limit(0)).count() == 0


def test_leaks(edges, tables):
    benchmark, _ = tables
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(edges, benchmark).collect()}
    assert found == {(5, 1), (6, 1), (4, 4)}
    assert decontamination.leaks(edges.limit(0), benchmark).count() == 0
    assert decontamination.leaks(edges, benchmark.limit(0)).count() == 0
    small = {(r.doc_id, r.item_id) for r in decontamination.leaks(edges, benchmark, pass_bytes=8).collect()}
    assert small == found  # several passes


def test_toxicity_without_labels(edges, edge_rows, spark):
    out = toxicity.classify(edges, spark.createDataFrame([], LABELS))
    assert out.count() == len(edge_rows) and out.filter("toxic").count() in (0, len(edge_rows))


def test_fingerprint_query_cases(spark, edges, edge_rows):
    named = fingerprints.with_next(fingerprints.with_sketch(edges.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch"), ["text", "sketch"])
    assert named.count() == len(edge_rows)
    one = named.filter("doc_id = 9").select("next.text").collect()
    assert one[0][0] == "﻿\x00odd \x1f bytes   here"


def test_chat(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, "assistant", "\\"), (None, None, "A:b", "### <"), (2, 5, "", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    out = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {None: 2, 1: 3, 2: 1}
    assert out[None].loss_chars == 1
    assert chat.read_back(turns.limit(0)).count() == 0
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/?q#x"), (5, "HTTP://WWW.Example.COM/en/?q#x"),
            (6, "http://a.net/es/" + "x" * 50_000), (None, "ftp://x.net/fr/\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = [(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge(pages).collect()]
    assert len(out) == len(rows)
    assert {x for x in out if x[0] in (1, 2, 3, 4)} == {(i, "", None, "allow") for i in (1, 2, 3, 4)}
    assert out.count((5, "www.example.com", "www.example.com/en/", "allow")) == 2
    assert (6, "a.net", "net/es/", "block") in out and (None, "x.net", "net/fr/", "block") in out
    assert urls.judge(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, edges, tmp_path, tables):
    benchmark, labels = tables
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    from dnslens.llm.common import staged

    for docs in (edges, edges.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, docs, str(tmp_path)))
            if name != "bpe":
                assert out.columns == docs.columns
                assert out.count() <= docs.count()
                docs = out
            else:
                assert out.count() == docs.count()
