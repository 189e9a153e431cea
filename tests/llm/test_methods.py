"""The corpus operators against brute force, libraries and SQL."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from check_oracles import compare, connect
from dnslens.llm import bpe, chat, decontamination, fingerprints, licences, lines, near, queries, substrings, toxicity, urls
from dnslens.llm.common import staged

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == ("ok", [])


# --- op2

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.op2_bpe(spark, FOLDER).collect()}
    for doc in docs.collect():
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        own = rows[doc.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_texts(library):
    coder, rng = bpe.word_bpe(bpe.default_path()), random.Random(3)
    letters = "aaabeeinntthxys'<|>/w ΣσİÉé0٣२ß漢\x1c\x1f\x85́👍🏽"
    for k in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        if k % 5 == 0:
            text += "<|endoftext|>" + text
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_round_trip(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    for doc in docs.collect():
        assert back[doc.doc_id] == library.decode(library.encode(doc.text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_automaton_equals_merging():
    """All words over two letters, for merges in any order, against merging by rank."""
    rng = random.Random(1)
    for _ in range(30):
        ids = {"a": 0, "b": 1, "a</w>": 2, "b</w>": 3}
        merges: list[tuple[str, str]] = []
        while len(merges) < 12:
            left, right = rng.choice(list(ids)), rng.choice(list(ids))
            if not left.endswith("</w>") and left + right not in ids:
                merges.append((left, right))
                ids[left + right] = len(ids)
        automaton = bpe.MergeAutomaton(["a", "b", "a</w>", "b</w>"], merges, ids)
        rank = {pair: k for k, pair in enumerate(merges)}
        for n in range(1, 9):
            for code in range(2**n):
                word = "".join("ab"[code >> i & 1] for i in range(n))
                parts = [*word[:-1], word[-1] + "</w>"]
                while True:
                    pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
                    if not pairs:
                        break
                    _, i = min(pairs)
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                assert automaton.encode(word) == [ids[p] for p in parts], (word, merges)
                assert automaton._search(word) == [ids[p] for p in parts]


# --- op3

def _sketch(text: str) -> list[int]:
    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split("[\\x20\\x09-\\x0D]+", text) if w]

    def chained(values):
        seed = 42
        for value in values:
            seed = xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed=seed)
        return signed(seed)

    runs = {chained(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {chained(words)} if words else set()
    low = sorted(x for x in runs if x < -(1 << 63) + (1 << 61))
    return low or ([min(runs)] if runs else [])


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    rows = {r.doc_id: r for r in fingerprints.op3_document_fingerprints(spark, FOLDER).collect()}
    assert len(rows) == len(docs)

    def shown(values):
        return "".join(f"{v & (1 << 64) - 1:016x}" for v in values)

    def alike(a, b):
        return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))

    for k, doc in enumerate(docs):
        following = docs[(k + 1) % len(docs)].text
        half = len(doc.text) // 2
        edited = doc.text[: len(doc.text) - half] + following[:half]
        own, changed = _sketch(doc.text), _sketch(edited)
        row = rows[doc.doc_id]
        assert row.n_chars == len(doc.text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (shown(own), shown(changed))
        assert row.near_edited == pytest.approx(alike(own, changed))
        assert row.near_next == pytest.approx(alike(own, _sketch(following)))


@pytest.mark.parametrize("ranges, documents", [(256, 20_000), (4, 3), (1, 1)])
def test_next_document(make_docs, ranges, documents):
    ids = random.Random(5).sample(range(-(10**15), 10**15), 40) + list(range(60))
    docs = make_docs([(i, f"t{i}") for i in ids]).select("doc_id", "text")
    order = sorted(ids, reverse=True)
    out = {r.doc_id: r.next.text for r in fingerprints.with_next(docs, ["text"], ranges, documents).collect()}
    assert out == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_containment_of_unequal_documents(spark, make_docs):
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words[1000:6000]))])
    sketches = {r.doc_id: r.sketch for r in fingerprints.fingerprints(docs).collect()}
    pair = spark.createDataFrame([(sketches[2], sketches[1])], "part array<long>, whole array<long>")
    row = pair.select(fingerprints.containment(F.col("part"), F.col("whole")).alias("c"),
                      (fingerprints.merged(F.col("part"), F.col("whole")) == F.col("whole")).alias("same")).first()
    assert row.c > 0.98 and row.same


# --- op4

def test_templates():
    render = chat.compile_template("{% for m in messages %}{% if m.role == 'a' or not m.text %}[{{ m.text ~ '!' | upper }}]{% else %}{{ m.text | trim }}{% endif %}{% endfor %}")
    assert "".join(x for x, _ in render({"messages": [{"role": "a", "text": "x"}, {"role": "b", "text": " y "}]})) == "[x!]y"
    assert chat.fold(chat.parse("a{% if 'x' == 'x' %}b{% else %}c{% endif %}{{ 'd' ~ 'e' | upper }}")) == [chat.Output(chat.Const("abdE"))]
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{{ x | eval }}", "{% for x in y %}", "{% import os %}", "{{ x[0] }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "### User: hi </turn>\n### Assistant: x", "", "\\", "\\\\n", "</turn>", "a\nb"]
    rows = [(1, i, ("user", "assistant", "Tool:#")[i % 3], t) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = [(r.text, r.generated) for r in chat.format_turns(turns).orderBy("piece").collect()]
    read = list(chat.read_turns(pieces))
    assert [(role, text) for role, text, _, _ in read] == [(r, t) for _, _, r, t in rows]
    assert "".join(m for _, _, m, _ in read) == "".join(t for _, _, r, t in rows if r == "assistant")


def test_chat_texts_that_end_like_a_turn(spark):
    texts = ["</turn>\n", "said </turn>\n", "\\</turn>\n", " </turn>\n", "\\ </turn>\n", "x </turn>\n </turn>\n"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(1, len(texts), "</turn>\n", "</turn>\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = [(r.text, r.generated) for r in chat.format_turns(turns).orderBy("piece").collect()]
    assert [(role, text) for role, text, _, _ in chat.read_turns(pieces)] == [(r, t) for _, _, r, t in rows]
    assert chat.read_back(turns).first().n_turns == len(rows)


# --- op5

def test_licences(spark, make_docs):
    mit = licences.KNOWN[0][1]
    changed = mit.replace("MIT License", "MIT LICENCE").replace("<year> <copyright holders>", "2020 Somebody Else").replace(",", " ,").replace("\n", "\r\n")
    docs = make_docs([(1, changed), (2, mit + " and more"), (3, "Some text.\n  * Released under the MIT licence\nmore\nAll Rights Reserved."), (4, "all rights reserved")])
    for limit in (licences.MAP_TEXTS, 0):
        old, licences.MAP_TEXTS = licences.MAP_TEXTS, limit
        try:
            rows = {r.doc_id: (r.license, r.notices, r.notice_lines) for r in licences.scan(docs).collect()}
        finally:
            licences.MAP_TEXTS = old
        assert rows == {1: ("MIT", "", 0), 2: (None, "", 0), 3: (None, "MIT,all-rights-reserved", 2), 4: ("all-rights-reserved", "all-rights-reserved", 1)}


def test_full_licences_and_headings(make_docs):
    mit, bsd = licences.KNOWN[0][1], licences.KNOWN[3][1]
    body = mit.split("\n", 2)[2]
    texts = licences.full_texts()
    apache = next(t for n, t in reversed(texts) if n == "Apache-2.0")  # the terms alone
    rows = {1: ("MIT", "The MIT License (MIT)\n\n" + body), 2: ("MIT", body), 3: ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd),
            4: ("BSD-3-Clause", re.sub(r"(?m)^\d[.] ", "* ", bsd)), 5: (None, body + "\nbut not for sale"), 6: (None, "MIT License"),
            7: ("Apache-2.0", " ".join(apache.split("\n", 4)[4].split())), 8: ("Apache-2.0", re.sub(r"^\s*Apache License\n", "", apache))}
    rows |= {20 + k: row for k, row in enumerate(texts)}
    rows |= {60 + k: (n, t.split("\n\n", 1)[0] + "\n\n" + t.split("\n\n", 1)[1].replace("\n", "\n  ")) for k, (n, t) in enumerate(texts)}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {n for n, _ in texts}
    found = {r.doc_id: r.license for r in licences.scan(make_docs([(k, t) for k, (_, t) in rows.items()])).collect()}
    assert found == {k: n for k, (n, _) in rows.items()}


# --- op6

def _smith_waterman(item: list[str], words: list[str]) -> float:
    table = np.zeros((len(item) + 1, len(words) + 1))
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if a == b else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return float(table.max(initial=0))


def test_leaks_against_all_pairs(spark, make_docs):
    rng = random.Random(11)
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if len(r.text) < 2500}
    for k, (item, text) in enumerate(list(items.items())[:20]):  # edited copies inside other texts
        words = text.split()
        for _ in range(len(words) // 8):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["changed"], [], [words[at], "put", "in"]])
        docs[10_000 + k] = f"before {' '.join(words).upper()} behind"
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(make_docs(list(docs.items())), benchmark).collect()}
    split = {i: decontamination.item_words(t) for i, t in items.items()}
    expected = {}
    for doc, text in docs.items():
        words = decontamination.item_words(text)
        for item, own in split.items():
            if len(set(own) & set(words)) * 2 >= len(set(own)):  # fewer cannot reach half the score
                score = _smith_waterman(own, words) / len(own)
                if score >= decontamination.MIN_SCORE:
                    expected[doc, item] = score
    assert {k: pytest.approx(v) for k, v in found.items()} == expected
    assert sum(k[0] >= 10_000 for k in found) == 20


def test_edited_copy_beside_verbatim_copies(make_docs):
    """An edited copy is found although the n-grams that it kept are the commoner ones."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    edited = [f"other{k}" if k in (6, 13, 20, 27, 33) else w for k, w in enumerate(words)]
    docs = [(0, f"before {' '.join(words)} behind")] + [(k, f"before {' '.join(edited)} behind") for k in range(1, 4)]
    docs += [(9, " ".join(words[:4]) + " and nothing else of the item")]
    item = make_docs([(7, " ".join(words))]).selectExpr("doc_id as item_id", "text")
    found = {r.doc_id: r.score for r in decontamination.leaks(make_docs(docs), item).collect()}
    expected = {k: _smith_waterman(words, decontamination.item_words(t)) / 40 for k, t in docs}
    assert found == {k: pytest.approx(v) for k, v in expected.items() if v >= decontamination.MIN_SCORE}
    assert set(found) == {0, 1, 2, 3}


# --- op7

def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    rows = toxicity.classify(docs.join(labels.select("doc_id"), "doc_id"), train).join(test.withColumnRenamed("toxic", "is"), "doc_id").collect()
    hit = sum(r.toxic and r["is"] == 1 for r in rows)
    wrong = sum(r.toxic and r["is"] == 0 for r in rows)
    assert hit >= 0.88 * sum(r["is"] for r in rows)
    assert wrong <= 0.005 * len(rows)


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 2000
    first = rng.integers(0, 2, n)
    rows, columns = np.arange(n), first  # feature 0 or 1 tells the first category
    labels = np.stack([first, first], axis=1).astype(float)
    models = toxicity.fit_chain(rows, columns, np.zeros((n, toxicity.SHAPES)), labels, np.arange(n) % 3, 2)
    assert len(models[1].dense) == len(models[0].dense) + 1 and models[1].dense[toxicity.SHAPES] > 0.3
    chain = toxicity.Chain(["a", "b"], {}, models)
    low, high = (chain.probabilities(np.array([i]), [0.0] * toxicity.SHAPES) for i in (0, 1))
    assert max(low) < 0.1 and min(high) > 0.9


# --- op8

def _sets(docs: dict[int, str], size: int) -> dict[int, set]:
    out = {}
    for i, text in docs.items():
        words = [w for w in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        out[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    return out


def _expected(docs: dict[int, str], size: int) -> dict[int, int]:
    sets, parent = _sets(docs, size), {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [near.BLOCK, 8])
def test_near_against_all_pairs(make_docs, monkeypatch, block):
    """A base with many edited copies that are seldom linked to each other, chains, and texts at the limit."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "PROPOSED", 1)
    rng = random.Random(2)
    base = [f"v{rng.randrange(10**5)}" for _ in range(120)]
    docs = {}
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            words[at] = f"e{rng.randrange(10**5)}"
        docs[100 + k] = " ".join(words)
    docs[500] = " ".join(base).upper()
    chain = list(base[:60]) + [f"c{i}" for i in range(60)]
    for k in range(12):
        docs[600 + k] = " ".join(chain)
        chain[k * 4 : k * 4 + 2] = [f"d{k}", f"f{k}"]
    docs[700] = docs[600]
    out = near.near_duplicates(make_docs(list(docs.items())), size=4).collect()
    assert {r.doc_id: r.component_id for r in out} == _expected(docs, 4)
    assert all(r.n_shingles == len(_sets({0: docs[r.doc_id]}, 4)[0]) for r in out)


@pytest.mark.parametrize(("block", "shingles"), [(near.BLOCK, 1 << 20), (4, 200)])
def test_near_unlinked_group(make_docs, monkeypatch, block, shingles):
    """Texts just below the limit to each other share many buckets: no stage holds more rows than the buckets do."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", shingles, raising=False)
    keep, counts = near.Scratch.keep, []

    def counted(self, name, df):
        out = keep(self, name, df)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(near.Scratch, "keep", counted)
    docs = {}
    for k, at in enumerate(range(3, 71, 4)):  # two texts share 63 of 79 shingles
        words = [f"w{x}" for x in range(74)]
        words[at] = f"e{k}"
        docs[k] = " ".join(words)
        docs[100 + k] = docs[k] + " more" if k % 5 == 0 else f"other {k}"
    out = near.near_duplicates(make_docs(list(docs.items())), size=4).collect()
    assert {r.doc_id: r.component_id for r in out} == _expected(docs, 4)
    most = next(n for name, n in counts if name == "members")
    assert most > 300 and all(n <= most for _, n in counts)


def test_odd_sketch_bound():
    """Pairs at the limit stay under the bound, however their rest is shared out; those well below it do not."""
    rng = np.random.default_rng(4)
    bounds = near.most_bits(near._SUMS, 80)
    assert (np.diff(bounds) >= 0).all()
    for union in (5, 40, 333, 1000, 5000):
        for _ in range(60):
            hashes = rng.integers(0, 2**64, union, dtype=np.uint64)
            bits = {}
            for percent, one in ((80, None), (60, 0.5)):
                rest = union * (100 - percent) // 100
                cut = int(rng.integers(0, rest + 1)) if one is None else rest // 2
                sets = [np.sort(np.concatenate([part, hashes[rest:]])) for part in (hashes[:cut], hashes[cut:rest])]
                sketch = near._sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
                bound = near._most(np.array([sum(map(len, sets))]), bounds)[0]
                bits[percent] = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()), bound
            assert bits[80][0] <= bits[80][1]
            assert union < 333 or bits[60][0] > bits[60][1]


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    out = {r.node: r.comp for r in near.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for pair in pairs for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert out == {x: root(x) for x in linked}


# --- op9

@pytest.mark.parametrize("split", [substrings.SPLIT_STRINGS, 1])
def test_substrings_against_all_windows(make_docs, split):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    docs = {}
    for k in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(5, 60))]
        at = rng.randrange(len(words))
        words[at:at] = passage[rng.randrange(8) : rng.randrange(12, 30)] * rng.choice([1, 1, 2])
        docs[k] = " ".join(words)
    docs[50] = docs[3]
    first: dict[tuple, int] = {}
    cut = {i: t.split() for i, t in docs.items()}
    for i in sorted(cut):
        for k in range(len(cut[i]) - 6):
            first.setdefault(tuple(cut[i][k : k + 7]), i)
    out = {r.doc_id: r for r in substrings.dedup(make_docs(list(docs.items())), window=7, size=3, split=split).collect()}
    for i, words in cut.items():
        gone = {p for k in range(len(words) - 6) if first[tuple(words[k : k + 7])] < i for p in range(k, k + 7)}
        assert out[i].n_removed == len(gone)
        assert out[i].text == " ".join(w for p, w in enumerate(words) if p not in gone)


# --- op10

def test_many_url_rules(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    few = {r.page_id: r for r in urls.judge(pages).collect()}
    old, urls.BROADCAST_RULES = urls.BROADCAST_RULES, 0
    try:
        many = {r.page_id: r for r in urls.judge(pages).collect()}
    finally:
        urls.BROADCAST_RULES = old
    assert few == many


# --- op1 and the pipeline

def test_line_templates(make_docs):
    rng = random.Random(8)
    docs = []
    for k in range(30):
        own = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(8)) + "." for _ in range(3))
        docs.append((k, f"{own}\nPosted by user{k} on day {k} of the month\nshort line"))
    copies = [(100 + k, "the same text in every copy here.\nand a second line of the copy.") for k in range(30)]
    out = {r.doc_id: r for r in lines.drop_recurring(make_docs(docs + copies)).collect()}
    assert all(out[k]._n_dropped == 1 and "Posted" not in out[k].text and "short line" in out[k].text for k, _ in docs)
    assert all(out[k]._n_dropped == 0 for k, _ in copies)


def test_pipeline_by_stage(spark):
    """Each stage's decisions against a plain version of it on the stage's own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    harmless = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 0").collect()}
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        docs = staged(stage(spark, docs, FOLDER))
        after = {r.doc_id: r.asDict() for r in docs.collect()}
        sizes[name] = (len(before), len(after))
        if name == "toxicity":
            assert not (set(before) - set(after)) & harmless
        elif name == "line dedup":
            assert set(after) == set(before)
        elif name == "near dedup":
            parts = _expected({i: r["text"] or "" for i, r in before.items()}, 5)
            assert set(after) == {i for i, c in parts.items() if i == c}
        elif name == "decontamination":
            for i in set(before) - set(after):
                assert any(len(set(decontamination.item_words(t)) & set(decontamination.item_words(before[i]["text"]))) * 2 >= len(set(decontamination.item_words(t)))
                           for t in [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
        else:
            assert set(after) == set(before)
    assert sizes["near dedup"][1] < sizes["near dedup"][0]
    assert corpus_pipeline.run(spark, FOLDER).count() == sizes["bpe"][1]
