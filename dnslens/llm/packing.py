"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnslens.llm.common import blocks, read_table, staged, text_bytes

CAPACITY = 1024
#: Id that ends every document.
END_ID = 2
#: Rows of one size that one task ranks; larger classes are dealt into buckets.
CLASS_ROWS = 1_000_000
#: Parts of a text whose ids are remembered.
CACHE_PARTS = 400_000
#: Longest part that is remembered.
CACHE_LENGTH = 48

# The byte-level pre-tokenizer over Latin letters, whose classes no Unicode version has changed.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ȳ"
_NUMBER = "0-9²³¹¼-¾"
_PARTS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts of these characters are cut here, others as a whole by the library.
_KNOWN = re.compile("[\x00-ȳ‐-‧€]*")


class _PartIds(dict):
    """Part of a text -> its ids as little-endian 32-bit integers, for a bounded number of parts.

    A full table becomes the old one, in which parts are looked up before they are encoded again.
    """

    def __init__(self, encode) -> None:
        self._encode = encode
        self._old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        found = self._old.get(part)
        if found is None:
            found = self._encode(part)
        if len(part) <= CACHE_LENGTH:
            if len(self) >= CACHE_PARTS:
                self._old = dict(self)
                self.clear()
            self[part] = found
        return found


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it is printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(0x100 + k) for k, x in enumerate(rest)}


class ByteBpe:
    """The ids of the tokenizers library; parts that recur are encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [x.content for x in self._tokenizer.get_added_tokens_decoder().values()]
        self._known = _PartIds(self._part)
        self._letters = _letters()

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self._letters)
        return np.array([x.id for x in self._tokenizer.model.tokenize(letters)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _KNOWN.fullmatch(text) is None or any(x in text for x in self._special):
            return self._whole(text)
        return b"".join(map(self._known.__getitem__, _PARTS.findall(text)))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
           capacity: int = CAPACITY, end: int = END_ID, ids: bool = False) -> DataFrame:
    """``key``, item (a number of its own), piece, start, length, ids_crc32 and, if asked for, ``ids``.

    Each text's ids and then ``end`` are one document. Those of more than ``capacity`` ids are cut into
    pieces of ``capacity``, the first of which may be shorter. Null and empty texts are the end id alone.
    Rows are independent: repeated rows give repeated pieces, other columns are not carried and may have
    any name, an empty table gives no piece. A text's ids are held by one task, 4 bytes each.
    Item numbers depend on how the rows lie in partitions: write the result before its use.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path or default_path())
        item = TaskContext.get().partitionId() << 33
        for batch in blocks(batches, "_text", 8 << 20):
            row, fields, cut = [], [], []
            for at, value in enumerate(batch.column("_text").to_pylist()):
                coded = coder.encode(value.decode("utf-8", "replace")) + tail
                n = len(coded) // 4
                first = (n - 1) % capacity + 1
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity)
                    part = coded[4 * start : 4 * stop]
                    row.append(at)
                    fields.append((item, k, start, stop - start, zlib.crc32(part)))
                    item += 1
                    if ids:
                        cut.append(np.frombuffer(part, "<i4"))
            numbers = np.array(fields, np.int64).reshape(-1, 5)
            columns = [batch.column("_key").take(pa.array(row, pa.int64())), pa.array(numbers[:, 0]), pa.array(numbers[:, 1].astype(np.int32)),
                       pa.array(numbers[:, 2]), pa.array(numbers[:, 3]), pa.array(numbers[:, 4])]
            if ids:
                columns.append(pa.array(cut, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.select(F.col(key).alias("_key"), text_bytes(text).alias("_text"))
    schema = "item long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = [key, *[part.split()[0] for part in schema.split(", ")]]
    return plain.mapInArrow(run, f"`{key}` {plain.schema['_key'].dataType.simpleString()}, {schema}")


def least_bins(docs: dict[int, int], capacity: int) -> int:
    """A number of sequences that items of these sizes (size -> count) need by themselves.

    The greatest of their total over the capacity and, for each k, of the items of which no k + 1 fit
    together over k.
    """
    need = -(-sum(size * n for size, n in docs.items()) // capacity)
    k, least = 1, min(docs, default=0)
    while docs and least * k <= capacity:
        need = max(need, -(-sum(n for size, n in docs.items() if size * (k + 1) > capacity) // k))
        k += 1
    return need


def sweep(docs: dict[int, int], slots: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """Heights of the sweep from the largest size down: size -> (slots' lowest height, documents' highest, documents served).

    Slots are put on a pile, documents take the topmost, which is the smallest slot that they fit into.
    The r-th slot of a size lies at ``lowest + r``, the r-th document takes ``highest - r``.
    """
    out, pile = {}, 0
    for size in sorted({*docs, *slots}, reverse=True):
        low = pile
        pile += slots.get(size, 0)
        served = min(docs.get(size, 0), pile)
        out[size] = low, pile - 1, served
        pile -= served
    return out


def topmost(docs: dict[int, int], slots: dict[int, int], heights: dict[int, tuple[int, int, int]]) -> dict[int, int]:
    """How many slots of each size the sweep takes: those at its top, the others stay under all that is taken later."""
    out, floor = {}, 1 << 62
    for size in sorted(heights):
        low, high, served = heights[size]
        floor = min(floor, high + 1 - served)
        out[size] = min(slots.get(size, 0), max(0, low + slots.get(size, 0) - floor))
    return out


def _slots(gap: int, most: int) -> list[tuple[int, int]]:
    """A gap's slots (size, number): as many as items of the largest size ``most`` fit, the last with all that is left."""
    n = max(1, gap // most)
    return [(most, n - 1), (gap - (n - 1) * most, 1)]


def _rank(rows: DataFrame, largest: int) -> Column:
    """Adds ``rank``: a number from 0 within (kind, size); a row of several slots (``number``) has the least of theirs.

    Slots are numbered from the largest id down, documents from the least up. Classes of more than ``CLASS_ROWS``
    rows are ranked bucket by bucket, each behind the counts of the buckets before it."""
    buckets = 1 + largest // CLASS_ROWS
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "run"), F.lit(buckets)).cast("int"))
    turned = F.when(F.col("kind") == 0, -F.col("id")).otherwise(F.col("id"))
    own = Window.partitionBy("kind", "size", "bucket").orderBy(turned, F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("rank", F.coalesce(F.sum("number").over(own), F.lit(0)).cast("long"))
    if buckets == 1:
        return ranked
    counts = dealt.groupBy("kind", "size", "bucket").agg(F.sum("number").alias("count"))
    before = Window.partitionBy("kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("kind", "size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    return ranked.join(offsets, ["kind", "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("ahead"))


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, sequence_id, offset for ``items`` (item: a number of its own, size: 1 to ``capacity``).

    Rounds over what is left: the documents (unplaced items) of more than half the largest one's size and
    the gaps (sequences with room) are sorted by size and swept from the largest down; every document goes to its successor, the smallest gap that it
    fits into. Documents that want the same gap are ranked, the next takes the next gap: slots and
    documents at the same height of the pile (``sweep``) meet in a window by height, which holds at most
    two rows a size. A gap offers as many slots as documents of the largest size fit, so it can take
    several in a round; slots are ranked as runs, and only those that a document takes become rows, as many
    in all rounds as there are documents. Then gaps are updated, and as many sequences are opened, by the largest documents
    without a place, as ``least_bins`` says that those without any gap need, or the room that is short.
    Smaller documents wait, to fill what the larger ones leave. Every round serves the largest documents,
    so it ends; the number of rounds depends on the sizes, about twice the logarithm of the capacity.

    The driver sees counts by size alone (two for each size up to the capacity). A sequence is named by
    the item that opened it. An empty table gives no rows.
    """
    spark = items.sparkSession
    whole = items.filter(F.col("size") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    state = items.filter(F.col("size") < capacity).select(F.lit(1).alias("kind"), F.col("item").alias("id"), F.col("size").cast("int").alias("size"))
    placed: DataFrame | None = None
    for turn in range(1 << 30):
        if turn:
            state = staged(state)
        counts: tuple[dict[int, int], dict[int, int]] = {}, {}
        for row in state.groupBy("kind", "size").count().collect():
            counts[row["kind"]][row["size"]] = row["count"]
        gaps, docs = counts
        if not docs:
            break
        short = sum(size * n for size, n in docs.items()) - sum(gap * n for gap, n in gaps.items())
        least, most, widest = min(docs), max(docs), max(gaps, default=0)
        docs = {size: n for size, n in docs.items() if 2 * size > most}
        lowest = min(docs)
        slots: dict[int, int] = {}
        for gap, n in gaps.items():
            for size, number in _slots(gap, most) if gap >= lowest else ():
                if number:
                    slots[size] = slots.get(size, 0) + number * n
        heights = sweep(docs, slots)
        tops = topmost(docs, slots, heights)
        opened = max(least_bins({size: n for size, n in docs.items() if size > widest}, capacity), -(-short // capacity))
        table = []
        for size, (low, high, served) in heights.items():
            new = max(0, min(opened, docs.get(size, 0) - served))
            opened -= new
            table.append((size, low + slots.get(size, 0) - 1, tops[size], high, served, served + new))
        plan = spark.createDataFrame(pa.table({name: pa.array(column, pa.int64()) for name, column in zip(
            ["size", "top", "taken", "high", "served", "opening"], zip(*table, strict=True), strict=True)}))

        full = F.greatest(F.lit(1), F.floor(F.col("size") / most)).cast("int") - 1
        active = F.col("size") >= lowest
        runs = F.array(F.struct(F.lit(0).alias("run"), F.lit(most).alias("part"), full.alias("number")),
                       F.struct(F.lit(1).alias("run"), (F.col("size") - full * most).cast("int").alias("part"), F.lit(1).alias("number")))
        offered = state.filter((F.col("kind") == 0) & active).select("kind", "id", F.col("size").alias("gap"), F.inline(runs)).filter(
            "number > 0").select("kind", "id", "run", "number", F.col("part").alias("size"), "gap")
        wanted = state.filter((F.col("kind") == 1) & active).select(
            "kind", "id", F.lit(0).alias("run"), F.lit(1).alias("number"), "size", F.lit(None).cast("int").alias("gap"))
        ranked = _rank(offered.unionByName(wanted), max(max(docs.values()), max(slots.values(), default=0))).join(F.broadcast(plan), "size")
        matched = F.when(F.col("kind") == 0, F.least(F.col("number").cast("long"), F.col("taken") - F.col("rank"))).otherwise(F.lit(1).cast("long"))
        each = F.explode_outer(F.when(matched > 0, F.sequence(F.lit(0).cast("long"), matched - 1)))
        put = ranked.withColumn("slot", each).withColumn(
            "height", F.when(F.col("kind") == 0, F.col("top") - F.col("rank") - F.col("slot")).when(F.col("rank") < F.col("served"), F.col("high") - F.col("rank")))
        opens = (F.col("kind") == 1) & (F.col("rank") < F.col("opening"))
        loose = put.filter("height is null").select("kind", "id", "size", "gap", F.when(opens, F.col("id")).alias("bin"), F.lit(0).alias("used"))
        level = Window.partitionBy("height").orderBy(F.desc("size"), "kind")
        taken = F.when(F.col("kind") == 1, F.lag("id").over(level))
        used = F.when((F.col("kind") == 0) & (F.lead("kind").over(level) == 1), F.lead("size").over(level)).otherwise(0)
        met = put.filter("height is not null").select("kind", "id", "size", "gap", taken.alias("bin"), used.alias("used"))
        done = staged(met.unionByName(loose))

        mine = done.filter("kind = 1 and bin is not null").select(
            F.col("id").alias("item"), "size", F.col("bin").alias("sequence_id"), F.lit(turn).alias("turn"))
        placed = mine if placed is None else placed.unionByName(mine)
        left = done.filter("kind = 0").groupBy("id").agg((F.first("gap") - F.sum("used")).cast("int").alias("size")).filter("size > 0")
        fresh = done.filter("kind = 1 and bin = id").select("id", (capacity - F.col("size")).cast("int").alias("size"))
        waiting = state.filter(~active & (F.col("size") >= least)).select("kind", "id", "size")
        state = waiting.unionByName(done.filter("kind = 1 and bin is null").select("kind", "id", "size")).unionByName(
            left.unionByName(fresh).select(F.lit(0).alias("kind"), "id", "size"))
    if placed is None:
        return whole
    own = Window.partitionBy("sequence_id").orderBy("turn", "item").rowsBetween(Window.unboundedPreceding, -1)
    return whole.unionByName(placed.select("item", "sequence_id", F.coalesce(F.sum("size").over(own), F.lit(0)).cast("long").alias("offset")))


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (written pieces) with sequence_id and offset."""
    return cut.join(best_fit(cut.select("item", F.col("length").alias("size")), capacity), "item")


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
              capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """sequence_id, ids and parts (``key``, piece, offset, length), a row for each packed sequence."""
    cut = staged(pieces(docs, key, text, path, capacity, end, ids=True))
    row = F.struct("offset", F.col(key).alias(key), "piece", "length", "ids")
    whole = packed(cut, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return whole.select("sequence_id", F.flatten("rows.ids").alias("ids"),
                        F.transform("rows", lambda x: F.struct(x[key].alias(key), x["piece"].alias("piece"), x["offset"].alias("offset"),
                                                               x["length"].alias("length"))).alias("parts"))


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1,024 ids."""
    cut = staged(pieces(read_table(spark, folder, "documents")))
    return packed(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
