"""BPE encoding and decoding with an automaton compiled from the merges."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm.common import blocks, kept, let_go, read_table, text_bytes

#: What a task remembers at most: words, runs between white space (two generations of so many), arcs.
CACHE_WORDS, CACHE_CHUNKS, MAX_ARCS = 200_000, 80_000, 500_000
#: Longer ones are not remembered.
CACHED_LENGTH = 32


class MergeAutomaton:
    """The deterministic automaton over tokens that accepts exactly the sequences BPE gives.

    It grows merge by merge. It begins with one loop per base symbol. The gadget of merge number k,
    ``u v -> w``, adds an arc ``w`` wherever ``u`` then ``v`` could be read, leads it to a copy of the
    state behind ``v``, and takes arc ``v`` away from the state behind ``u``. So a state is known by the
    token read last, and a later state is an earlier one copied at time k less the arcs taken since:
    ``_parts`` keeps that history, one entry per token, instead of 49,000 full rows. A row's entry is
    worked out from it when a word first asks (``_arc``) and stays in the table ``arcs``.
    """

    def __init__(self, base: list[str], merges: list[tuple[str, str]], ids: dict[str, int]):
        self.ids = ids
        self._rank = {(ids[u], ids[v]): k for k, (u, v) in reversed(list(enumerate(merges)))}
        self._time = {ids[symbol]: -1 for symbol in base}
        self._parts: dict[int, tuple[int, int]] = {}
        self.arcs: dict[int, bool] = {}
        self.live = set(self._time)
        for k, (u, v) in enumerate(merges):
            a, b, w = ids[u], ids[v], ids[u + v]
            if w in self._time or not (a in self.live and b in self.live and self._arc(a, b, k)):
                continue  # no path reads u then v any more: the gadget adds nothing
            self._time[w], self._parts[w] = k, (a, b)
            self.live.add(w)
        labels = {i: token for token, i in ids.items()}
        #: the trie of the arcs' labels: prefix -> token id, or -1 where the prefix is no token itself
        self.trie: dict[str, int] = {}
        for i in self.live:
            label, suffix = self._symbols(labels[i])
            for end in range(1, label + 1):
                self.trie.setdefault(labels[i][:end] if end < label or not suffix else labels[i], -1)
            self.trie[labels[i]] = i
        self.tokens = {labels[i]: i for i in self.live}
        self.longest = max(self._symbols(labels[i])[0] for i in self.live)
        self.arcs.clear()

    SUFFIX = "</w>"

    def _symbols(self, token: str) -> tuple[int, bool]:
        ends = token.endswith(self.SUFFIX) and len(token) > len(self.SUFFIX)
        return (len(token) - len(self.SUFFIX) if ends else len(token)), ends

    def _arc(self, x: int, y: int, time: int) -> bool:
        """May ``y`` follow ``x`` in the automaton of the merges before ``time``?"""
        rank, born, parts = self._rank, self._time, self._parts
        while True:
            if rank.get((x, y), time) < time:
                return False
            tx, ty = born[x], born[y]
            if tx < 0 and ty < 0:
                return True
            if tx >= ty:  # the state behind x was copied from the one behind its right part, before merge tx
                x, time = parts[x][1], tx
            else:  # arc y went along its left part's arc, with merge ty done
                y, time = parts[y][0], min(time, ty + 1)

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word (byte-level letters, without the suffix).

        The accepted path that spells the word is unique. It is sought by taking the longest arc first;
        what led nowhere is not tried again, so the time is linear in the word.
        """
        n, arcs, get, end, longest = len(word), self.arcs, self.tokens.get, word + self.SUFFIX, self.longest
        out: list[int] = []
        ends: list[int] = []
        i, before, back = 0, -1, 0
        while i < n:
            token = get(end[i:]) if n - i <= longest else None
            j = n if n - i <= longest else i + longest + 1
            while token is None or before >= 0 and not (
                arcs[before << 20 | token] if before << 20 | token in arcs else self._new_arc(before, token)
            ):
                j -= 1
                while j == i:  # no arc leads on: take the last one back, try a shorter one
                    back += 1
                    if back > 2 * n:
                        return self._search(word)
                    out.pop()
                    i = ends.pop()
                    before = out[-1] if out else -1
                    j -= 1
                token = get(word[i:j])
            out.append(token)
            ends.append(i)
            i, before = j, token
        return out

    def _new_arc(self, before: int, token: int) -> bool:
        if len(self.arcs) >= MAX_ARCS:
            self.arcs.clear()
        go = self.arcs[before << 20 | token] = self._arc(before, token, len(self._rank) + 1)
        return go

    def _search(self, word: str) -> list[int]:
        arcs, new_arc = self.arcs, self._new_arc
        n, path, dead = len(word), [], set()
        options = [self._labels_at(word, 0)]
        while options:
            if not options[-1]:
                options.pop()
                if path:
                    dead.add((path[-1][0], path.pop()[1]))
                continue
            end, token = options[-1].pop()
            if path:
                pair = path[-1][1] << 20 | token
                if not (arcs[pair] if pair in arcs else new_arc(path[-1][1], token)):
                    continue
            if (end, token) in dead:
                continue
            path.append((end, token))
            if end == n:
                return [token for _, token in path]
            options.append(self._labels_at(word, end))
        if n:
            raise ValueError(f"no path for {word[:80]!r}")
        return []

    def _labels_at(self, word: str, i: int) -> list[tuple[int, int]]:
        """(end, token) of the arcs whose label stands at ``i``, the longest last."""
        n, trie, out = len(word), self.trie, []
        for j in range(i + 1, min(n - 1, i + self.longest) + 1):
            token = trie.get(word[i:j])
            if token is None:
                return out
            if token >= 0:
                out.append((j, token))
        if n - i <= self.longest and (token := trie.get(word[i:] + self.SUFFIX, -1)) >= 0:
            out.append((n, token))
        return out


#: The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on.
def byte_letters() -> list[str]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


#: Fixed values of the vocabulary file: how it cuts texts into words (letters, digits and white space to be filled in).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: Unicode white space; str.split also cuts at U+001C to U+001F, which are words here.
SPACE = "\t-\r \x85\xa0  -     　"


def _ranges(kind: str) -> str:
    """The code points of a major category, as the inside of a character class."""
    out, first = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == kind
        if inside and first is None:
            first = code
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{code - 1:08x}")
            first = None
    return "".join(out)


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file of word BPE (NFC, lower case, byte letters, word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.ids = dict(model["model"]["vocab"])
        self.special = {token["content"]: token["id"] for token in model["added_tokens"]}
        suffix = model["model"]["end_of_word_suffix"]
        self.letters = byte_letters()
        base = self.letters + [letter + suffix for letter in self.letters]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["model"]["merges"]]
        ids = self.ids
        # a merge of two parts joins their labels; the suffix stands at the end of the right part only
        self.automaton = MergeAutomaton(base, merges, ids)
        names = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            names[i] = token
        self.labels = names
        self._nfc = unicodedata.normalize
        self._words = re.compile(WORDS.format(L=_ranges("L"), N=_ranges("N"), S=SPACE))
        self._cut = re.compile(f"[{SPACE}]+")
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._new: dict[str, tuple[bytes, bytes]] = {}
        self._old: dict[str, tuple[bytes, bytes]] = {}
        self._word_ids: dict[str, list[int]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word."""
        found = self._word_ids.get(word)
        if found is None:
            letters = self.letters
            spelled = word if word.isascii() and word.isprintable() else "".join([letters[b] for b in word.encode()])
            found = self.automaton.encode(spelled)
            if len(word) <= CACHED_LENGTH:
                if len(self._word_ids) >= CACHE_WORDS:
                    self._word_ids.clear()
                self._word_ids[word] = found
        return found

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a run of characters without white space."""
        if chunk.isascii():
            text = chunk.lower()
            if text.isalpha():
                return self.encode_word(text)
        else:
            # letter by letter: a sigma at a word's end stays the plain one
            text = self._nfc("NFC", chunk).replace("\u03a3", "\u03c3").lower()
        out: list[int] = []
        for word in self._words.findall(text):
            out += self.encode_word(word)
        return out

    def _entry(self, chunk: str) -> tuple[bytes, bytes]:
        found = self._old.get(chunk)
        if found is None:
            ids = self.encode_chunk(chunk)
            found = array("I", ids).tobytes(), " ".join([self.labels[i] for i in ids]).encode()
        if len(chunk) <= CACHED_LENGTH:
            if len(self._new) >= CACHE_CHUNKS:
                self._old, self._new = self._new, {}
            self._new[chunk] = found
        return found

    def pieces(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, arc labels) of each run of the text that has tokens."""
        for part in self._special.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield array("I", [self.special[part]]).tobytes(), part.encode()
                continue
            chunks = part.split() if not any(x in part for x in "\x1c\x1d\x1e\x1f") else self._cut.split(part)
            get, entry = self._new.get, self._entry
            for chunk in chunks:
                found = get(chunk) or entry(chunk)
                if self._new.get is not get:
                    get = self._new.get
                if found[0]:
                    yield found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([ids for ids, _ in self.pieces(text)]), "<u4")

    def decode(self, ids) -> str:
        """The arc labels in order, with a blank between two (as ids without a decoder read)."""
        return " ".join([self.labels[i] for i in ids])


def word_bpe(path: str) -> WordBpe:
    """The coder of a file, with all it remembers (some 200 MB) kept for the worker's next tasks of this step."""
    return kept("word_bpe", path, lambda: WordBpe(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _map_texts(docs: DataFrame, key: str, text: str, path: str | None, schema: str,
               fields: Callable[[WordBpe, str], list]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(path or default_path())
        for batch in blocks(batches, "_text", 8 << 20, "word_bpe"):
            rows = [fields(coder, x.decode("utf-8", "replace")) for x in batch.column("_text").to_pylist()]
            columns = [pa.array(list(column)) for column in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *columns], names)

    plain = docs.select(F.col(key).alias("_key"), text_bytes(text).alias("_text"))
    key_type = plain.schema["_key"].dataType.simpleString()
    names = [key, *[part.split()[0] for part in schema.split(", ")]]
    return plain.mapInArrow(run, f"`{key}` {key_type}, {schema}")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every whole text; null and empty texts have no ids.

    Rows are independent: repeated rows give repeated results, other columns are not carried and may
    have any name, an empty table gives an empty one. A very long text is read as a whole, but in
    pieces between white space, so time and memory are linear in it.
    """
    return _map_texts(docs, key, text, path, "ids array<int>", lambda coder, x: [coder.encode(x).astype(np.int32)])


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and ``text``: the labels of the ids, joined by blanks; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("word_bpe")
        labels = word_bpe(path or default_path()).labels
        for batch in batches:
            texts = [" ".join([labels[i] for i in row or ()]) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    plain = encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    return plain.mapInArrow(run, f"`{key}` {plain.schema['_key'].dataType.simpleString()}, text string")


def _digests(coder: WordBpe, text: str) -> list:
    found = list(coder.pieces(text))
    ids = b"".join([x for x, _ in found])
    return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b" ".join([x for _, x in found])).hexdigest()]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document the number of tokens and digests of its ids and of their decoded text, in one pass."""
    return _map_texts(docs, key, text, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(read_table(spark, folder, "documents"))
