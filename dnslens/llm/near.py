"""Near-duplicate documents: MinHash bands, odd sketches for candidates, full sets for links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnslens.llm.common import UPPER, Scratch, WordHashes, blocks, grams, let_go, mix, read_table, squeezed, text_bytes, unsqueezed
from dnslens.session import broadcast_if_small

#: 48 bands of 6 rows: two sets that share 0.8 of their union miss every band with probability 5e-7, two
#: that share 0.3 meet in one with 0.03.
BANDS, ROWS = 48, 6
#: Bits of an odd sketch, and ranges of the hash of which it holds the least hash each.
SKETCH_BITS, BINS = 2048, 4096
#: Candidates whose sketches differ in more bits than sets at the limit would, by this many standard
#: deviations, are no links (3 in 10^7 links at the limit would be lost, fewer above it).
DEVIATIONS = 5.0
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Documents whose ids are broadcast to pick their texts (8 bytes each).
FILTER_IDS = 200_000
#: Shingles of the members that one task compares with as many others (8 bytes each).
BLOCK_SHINGLES = 1 << 20
#: Nearest least members of its buckets that a class is compared with at first.
PROPOSED = 1


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (base[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (base[n:] >> np.uint64(32)).astype(np.uint32)


def _sets(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin.

    A text with fewer than ``size`` words is one shingle, one without words has none.
    """
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = grams(words, size)
    at = np.flatnonzero(np.arange(len(whole)) + size <= starts[1:][row[: len(whole)]])
    values, rows = [whole[at]], [row[at]]
    for n in range(1, size):
        short = np.flatnonzero(lengths == n)
        if len(short):
            values.append(grams(words, n)[starts[:-1][short]])
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(lengths) + 1))


def _bands(values: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of sets (none of them empty). Each sample is the least of the hashes' upper halves
    under a permutation of 32-bit numbers."""
    mul, add = _coefficients(bands * rows)
    band = np.zeros((len(begin) - 1, bands), np.uint64)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for k in range(bands * rows):
        least = mix(np.minimum.reduceat(short * mul[k] + add[k], begin[:-1]).astype(np.uint64) + (np.uint64(k + 1) << np.uint64(32)))
        band[:, k // rows] = mix(band[:, k // rows] ^ least)
    band ^= mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :]
    return band.view(np.int64)


def _sketches(values: np.ndarray, begin: np.ndarray, bits: int = SKETCH_BITS, bins: int = BINS) -> np.ndarray:
    """Odd sketches of sets (sorted hashes, no set empty).

    MinHash by one permutation: the hash's range is cut into ``bins``, and the least hash in each is a sample.
    The sketch folds the samples into the parity of bits: equal samples of two sets cancel in the XOR.
    """
    count = len(begin) - 1
    row = np.repeat(np.arange(count), np.diff(begin))
    part = values // np.uint64((1 << 64) // bins)
    new = np.ones(len(values), bool)
    new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    place, row = ((mix(values[new]) >> np.uint64(17)) % np.uint64(bits)).astype(np.int64), row[new]
    out = np.zeros((count, bits // 8), np.uint8)
    for first in range(0, count, 256):
        mine = slice(*np.searchsorted(row, [first, first + 256]))
        size = min(256, count - first)
        odd = np.bincount((row[mine] - first) * bits + place[mine], minlength=size * bits) & 1
        out[first : first + size] = np.packbits(odd.astype(np.uint8).reshape(size, bits), axis=1)
    return out


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty), bands, sketch."""
    lowered = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches, "_text"):
            words, starts = hashes.of([x.translate(lowered) for x in batch.column("_text").to_pylist()])
            values, begin = _sets(words, starts, size)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            keys: list = [None] * len(n)
            band_rows: list = [None] * len(n)
            sketch_rows: list = [None] * len(n)
            if len(full):
                ends = np.append(begin[:-1][full], begin[-1])
                band, sketch = _bands(values, ends, bands, rows), _sketches(values, ends)
                for i, at in enumerate(full.tolist()):
                    keys[at] = xxhash.xxh128_digest(values[begin[at] : begin[at + 1]].tobytes())
                    band_rows[at] = band[i]
                    sketch_rows[at] = sketch[i].tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()),
                pa.array(band_rows, pa.list_(pa.int64())), pa.array(sketch_rows, pa.binary()),
            ], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, size: int, pressed: bool) -> DataFrame:
    """doc_id and the full set of shingle hashes of each document; ``pressed`` texts are compressed ones."""
    lowered = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in blocks(batches, "_text"):
            texts = unsqueezed(batch.column("_text")) if pressed else batch.column("_text").to_pylist()
            words, starts = hashes.of([x.translate(lowered) for x in texts])
            values, begin = _sets(words, starts, size)
            shingles = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), shingles], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def most_bits(total: np.ndarray, percent: int, bits: int = SKETCH_BITS, bins: int = BINS, deviations: float = DEVIATIONS) -> np.ndarray:
    """Most differing bits of the sketches of two sets at the limit or above it, by the sum of their sizes.

    Of the union's samples a share of 1 - limit differs; a sample of one set alone, in a range where the other has
    nothing, is one element of the XOR, else there are two. Samples are drawn without replacement, so small sets hardly
    vary. n elements leave ``(1 - (1 - 2 / bits) ** n) / 2`` of the bits odd.
    """
    limit, union = percent / 100, np.maximum(total, 1) / (1 + percent / 100)
    load = union / bins
    alone = load * (1 - limit) / 2
    filled = -np.expm1(-load)
    flips = 2 * bins * (filled * (1 - limit) + np.exp(-load * limit - alone) * np.expm1(-alone))
    spread = 2 * np.sqrt(bins * filled * limit * (1 - limit) * np.maximum(0, 1 - bins * filled / union))
    kept = (1 - 2 / bits) ** flips
    places = bits * (bits - 1) / 4 * (1 - 4 / bits) ** flips + bits / 4 - bits**2 / 4 * kept**2
    return np.ceil(bits * (1 - kept) / 2 + deviations * np.sqrt((spread * kept) ** 2 + np.maximum(places, 0)) + 3).astype(np.int64)


#: Sums of sizes for which the bound is worked out; it rises with the sum, so the next larger one serves those between.
_SUMS = np.unique(np.ceil(np.geomspace(1, 1 << 40, 4000)).astype(np.int64))


def _most(total: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return bounds[np.minimum(np.searchsorted(_SUMS, total), len(_SUMS) - 1)]


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, comp: the least node that each node of ``links`` (a, b) reaches.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour;
    both are grouped minima, so a node with many links is folded on the map side.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.keep("edges", links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.filter("a <> b")
        low = small.groupBy("a").agg(F.min("b").alias("m"))
        hung = small.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = scratch.keep("edges", hung.filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _merged(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``label`` (node, comp; nodes without a row are their own) after new ``links`` (a, b).

    Only the labels that the new links connect go through ``components``.
    """
    own = label.withColumnsRenamed({"node": "a", "comp": "x"})
    named = links.join(own, "a", "left").join(own.withColumnsRenamed({"a": "b", "x": "y"}), "b", "left").select(
        F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    among = components(named, scratch).withColumnsRenamed({"comp": "_least", "node": "comp"})
    known = label.join(among, "comp", "left").select("node", F.coalesce("_least", "comp").alias("comp"))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    fresh = ends.join(label, "node", "left_anti").join(among.withColumnRenamed("comp", "node"), "node").select("node", F.col("_least").alias("comp"))
    return scratch.keep("label", known.unionByName(fresh))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share ``percent`` of their union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right_set"))
    both = F.size(F.array_intersect("left_set", "right_set"))
    size = F.size("left_set") + F.size("right_set")
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (size - both)).select("a", "b")


def _likely(left: dict, right: dict, bounds: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block its partners of other labels that sketches and sizes allow, the likeliest first."""
    for at in range(0, len(left["doc"]), 64):
        rows = slice(at, at + 64)
        bits = np.bitwise_count(left["sketch"][rows, None, :] ^ right["sketch"][None, :, :]).sum(axis=2, dtype=np.int32)
        near = (bits <= bounds[-1]) & (left["comp"][rows, None] != right["comp"][None, :])
        m, n = left["n_shingles"][rows, None], right["n_shingles"][None, :]
        small, large = np.minimum(m, n), np.maximum(m, n)
        near &= bits <= _most(m + n, bounds)
        near &= 100 * small >= percent * large  # else even a set inside the other is too small
        for i in np.flatnonzero(near.any(axis=1)):
            some = np.flatnonzero(near[i])
            yield at + int(i), some[np.lexsort((right["doc"][some], bits[i][some]))]


def _forest(left: dict, right: dict, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) that join all labels of the two blocks which links of full sets join; one less than labels at most.

    A pair is looked at only while its labels are apart, and then decided on the full sets.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i, some in _likely(left, right, bounds, percent):
        mine, own = left["sets"][i], root(int(left["comp"][i]))
        for j in some.tolist():
            other = root(int(right["comp"][j]))
            if other == own:
                continue
            theirs = right["sets"][j]
            at = np.searchsorted(mine, theirs)
            both = int((mine[np.minimum(at, len(mine) - 1)] == theirs).sum())
            if 100 * both >= percent * (len(mine) + len(theirs) - both):
                out.append((int(left["doc"][i]), int(right["doc"][j])))
                parent[max(own, other)] = own = min(own, other)
    return out


def _by_task(tasks: DataFrame, columns: list[str], block: Callable[[tuple, dict, dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``block`` of every task: its key, and its two sides as arrays by name.

    Each task's rows (two blocks, see ``_tasks``) lie together, sorted, in one partition;
    they pass by in order, so memory holds one task.
    """
    names = ["bucket", "kind", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        rest: pa.Table | None = None

        def work(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            keys = np.stack([table.column(n).to_numpy() for n in names], axis=1)
            side = table.column("side").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], change, [len(keys)]])
            if not last:
                bounds = bounds[:-1]
            found = []
            for begin, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = table.slice(begin, stop - begin)
                data: dict = {"doc": part.column("doc_id").to_numpy(), "comp": part.column("comp").to_numpy(), "outer": part.column("outer").to_numpy()}
                if "sketch" in columns:
                    data["n_shingles"] = part.column("n_shingles").to_numpy()
                    data["sketch"] = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint64).reshape(stop - begin, -1)
                else:
                    lists = part.column("shingles").combine_chunks()
                    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
                    values = lists.flatten().to_numpy().view(np.uint64)
                    data["n_shingles"] = np.diff(ends)
                    data["sketch"] = _sketches(values, ends).view(np.uint64)
                    data["sets"] = np.empty(stop - begin, object)
                    data["sets"][:] = [values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                cut = int(np.searchsorted(side[begin:stop], 1))
                _, kind, i, j = key = tuple(keys[begin].tolist())
                among = kind == 2 or kind == 1 and i == j  # the outside is compared with itself as well
                left, right = {k: v[cut:] for k, v in data.items()}, data if among else {k: v[:cut] for k, v in data.items()}
                if len(left["doc"]) and len(right["doc"]) and (made := block(key, left, right)) is not None:
                    found.append(made)
            return found, None if last else table.slice(int(bounds[-1]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            if len(rest):
                out, rest = work(rest, False)
                yield from out
        if rest is not None and len(rest):
            yield from work(rest, True)[0]

    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(parts, *names).sortWithinPartitions(*names, "side")
    return dealt.select(*names, "side", "doc_id", "comp", "outer", *columns).mapInArrow(run, schema)


def undecided(tasks: DataFrame, percent: int) -> DataFrame:
    """bucket, doc_id, comp, outer, n_shingles: the rows of a bucket whose sketch allows a link to another label there."""
    limits = most_bits(_SUMS, percent)
    names = ["doc", "comp", "outer", "n_shingles"]

    def block(key: tuple, left: dict, right: dict) -> pa.RecordBatch | None:
        mine, theirs = np.zeros(len(left["doc"]), bool), np.zeros(len(right["doc"]), bool)
        for i, some in _likely(left, right, limits, percent):
            mine[i] = theirs[some] = True
        if not mine.any():
            return None
        columns = [np.concatenate([left[n][mine], right[n][theirs]]) for n in names]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), key[0], np.int64)), *map(pa.array, columns)],
                                          ["bucket", "doc_id", "comp", "outer", "n_shingles"])

    found = _by_task(tasks, ["n_shingles", "sketch"], block, "bucket long, doc_id long, comp long, outer int, n_shingles long")
    return found.groupBy("bucket", "doc_id").agg(F.min("comp").alias("comp"), F.max("outer").alias("outer"), F.max("n_shingles").alias("n_shingles"))


def forests(tasks: DataFrame, percent: int) -> DataFrame:
    """a, b: links of full sets that join, task by task, all labels which links join there."""
    limits = most_bits(_SUMS, percent)

    def block(key: tuple, left: dict, right: dict) -> pa.RecordBatch | None:
        found = _forest(left, right, limits, percent)
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_task(tasks, ["shingles"], block, "a long, b long").distinct()


def _open(members: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """The members of buckets that still have several labels: bucket, doc_id, comp, outer.

    Members with the label of a bucket's least member are its inside, the others its outside.
    """
    own = members.join(broadcast_if_small(comp.withColumnRenamed("node", "doc_id"), FILTER_IDS), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    lead = own.groupBy("bucket").agg(F.min_by("comp", "doc_id").alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    lead = scratch.keep("lead", lead.filter("c0 < c1").select("bucket", "main"))
    split = own.join(broadcast_if_small(lead, FILTER_IDS), "bucket")
    return scratch.keep("open", split.select("bucket", "doc_id", "comp", (F.col("comp") != F.col("main")).cast("int").alias("outer")))


def _tasks(split: DataFrame, weight: Column) -> DataFrame:
    """The blocks of open members that must still be compared: task, side, doc_id, comp, outer.

    Links may be missing between outside and inside and among the outside. Both are dealt into blocks of at most
    ``BLOCK`` rows and ``BLOCK_SHINGLES`` of ``weight`` or so. A task (kind 0) gets an outside block (side 1) and an
    inside one, or (kind 1) two outside blocks, or one alone; a bucket of one block each is one task (kind 2). Work so
    grows with the outside, which is empty once a bucket's copies have one label.
    """
    def number(inside: bool) -> Column:
        mine = F.col("outer") == (0 if inside else 1)
        return F.ceil(F.greatest(F.count_if(mine) / BLOCK, F.sum(F.when(mine, weight).otherwise(0)) / BLOCK_SHINGLES)).cast("int")

    counts = split.groupBy("bucket").agg(number(False).alias("outs"), number(True).alias("ins"))
    dealt = split.join(counts, "bucket").withColumn("h", F.xxhash64("doc_id"))
    outside = F.col("outer") == 1
    block = F.pmod("h", F.when(outside, F.col("outs")).otherwise(F.col("ins")))
    dealt = dealt.withColumn("block", block.cast("int"))

    def task(kind: int, i: Column, j: Column, side: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    def up_to(count: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), count), lambda x: x < count)

    mine, outs, ins = F.col("block"), F.col("outs"), F.col("ins")
    outer = F.concat(
        F.transform(up_to(ins), lambda x: task(0, mine, x, 1)),
        F.transform(F.sequence(mine, F.greatest(mine, outs - 1)), lambda x: task(1, mine, x, 1)),
        F.transform(up_to(mine), lambda x: task(1, x, mine, 0)))
    inner = F.transform(up_to(outs), lambda x: task(0, x, mine, 0))
    alone = F.array(task(2, F.lit(0), F.lit(0), 1)), F.array(task(2, F.lit(0), F.lit(0), 0))
    one = (outs <= 1) & (ins <= 1)
    into = F.when(one & outside, alone[0]).when(one, alone[1]).when(outside, outer).otherwise(inner)
    return dealt.select("bucket", "doc_id", "comp", "outer", F.inline(into))


def _differing(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sketches and sizes allow a link, with ``bits``, the bits that differ."""
    bounds = most_bits(_SUMS, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            m, n = (batch.column(x).to_numpy() for x in ("m", "n"))
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(m), SKETCH_BITS // 64) for c in ("x", "y"))
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (bits <= _most(m + n, bounds))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(bits)], ["a", "b", "bits"]).filter(pa.array(keep))

    left = sketches.withColumnsRenamed({"doc_id": "a", "sketch": "x", "n_shingles": "m"})
    right = sketches.withColumnsRenamed({"doc_id": "b", "sketch": "y", "n_shingles": "n"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long, bits long")


def near_components(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    ``docs``: doc_id, _text (bytes). Documents with the same set are one class, and only its least
    doc_id is compared. Classes that share a band are candidates; equal buckets are looked at once.
    First every class is compared with the nearest, by odd sketch, of the least candidates of its buckets. The rows of
    buckets that still have several labels are compared by sketch, block by block; those that may have a link
    to another label meet again with their full sets, and each task gives a forest of links: no more rows than it has read,
    and no link between different sets is passed over. All links are confirmed on full sets; only documents of such
    rows have their sets made. Labels are brought up to date from new links alone, and stages that are replaced are deleted.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.keep("marks", signatures(docs, size))
    classes = scratch.keep("classes", marks.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    exploded = classes.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("bucket"))
    buckets = exploded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.bit_xor(F.xxhash64("doc_id")).alias("mark")).filter("n > 1")
    once = buckets.groupBy("n", "lo", "mark").agg(F.min("bucket").alias("bucket"))
    members = scratch.keep("members", exploded.join(once.select("bucket", "lo"), "bucket"))
    sketches = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "sketch")
    leads = _differing(members.filter("doc_id <> lo").select(F.col("doc_id").alias("a"), F.col("lo").alias("b")).distinct(), sketches, percent)
    nearest = leads.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("bits", "b"))).alias("near"))  # BANDS of them at most
    first = nearest.select("a", F.inline(F.slice("near", 1, PROPOSED))).select("a", "b")
    label = docs.sparkSession.createDataFrame([], "node long, comp long")

    def sets_of(ids: DataFrame) -> DataFrame:
        # repeated rows of one id give it several sets: a link of any of them counts
        wanted = ids.distinct()
        if wanted.limit(FILTER_IDS + 1).count() <= FILTER_IDS:
            wanted = F.broadcast(wanted)
            texts, pressed = docs, False
        else:
            texts, pressed = squeezed(docs), True  # before the shuffle
        return scratch.keep("sets", shingle_sets(texts.join(wanted, "doc_id", "left_semi"), size, pressed))

    pairs = scratch.keep("pairs", first)
    sets = sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    label = _merged(label, scratch.keep("links", confirmed(pairs, sets, percent)), scratch)
    scratch.drop("pairs", "sets")
    tasks = _tasks(_open(members.select("bucket", "doc_id"), label, scratch), F.lit(0)).join(sketches, "doc_id")
    rest = scratch.keep("rest", undecided(tasks, percent))
    scratch.drop("members", "open", "lead")
    sets = sets_of(rest.select("doc_id"))
    found = forests(_tasks(rest, F.col("n_shingles")).join(sets.filter(F.size("shingles") > 0), "doc_id"), percent)
    label = _merged(label, scratch.keep("links", found), scratch)
    scratch.drop("rest", "sets", "links", "edges")
    whole = marks.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left").join(
        label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = 5) -> DataFrame:
    """Classes of near-duplicate texts: doc_id, n_shingles, component_id (least reachable key), kept.

    Texts are linked if their sets of ``size``-word shingles (A-Z lower-cased) share ``percent`` percent
    of their union. Fewer words are one shingle; null, empty and blank texts have an empty set and are
    linked with nothing. Rows with a null key are left out. Repeated rows of one key stay rows and share
    their component. Other columns are not carried and may have any name; an empty table gives none.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("_text"))
    return near_components(plain.filter("doc_id is not null"), percent, size)


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"), size=4)


SQL = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
    FROM cut, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY x, y),
links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * common >= 80 * (p.n + q.n - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""
