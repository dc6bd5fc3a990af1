"""Operator 7: Jaccard join on word shingles by parity sketches.

A text's set is its distinct shingles (64-bit hashes of n words). If the Jaccard similarity of two sets
is at least t, and the smaller has m members, their symmetric difference has at most
d = (1 - t) * m / t members. Sets are put in bands by size; a band has one d and one sketch. A sketch
deals the members by hash to d + 1 + r parts and XORs their hashes in each part, so that a member of
the difference changes one part at most: r + 1 parts at least are equal. Each set leaves out its r
parts with the fewest members (on a tie, the first ones); of the equal parts of two similar sets, the
last in that order is left out by neither, so an equi-join on parts loses no pair. A set also enters
the sketch of the band below if partners there are possible. A second sketch holds one parity bit for
each of four to eight buckets a member, a power of two in all, so that a larger one folds to the size of
a smaller one; its Hamming distance is a lower bound of the difference too, and drops candidates before
their sets are compared exactly.

The part keys are grouped in SLICES runs, each over the keys of one remainder, as shuffles of all of them
at once are what takes the most disk. Only keys of two nodes or more are kept, and of keys with the very
same nodes (known by two XORs of their hashes) one.

Equal sets count as one node, named by its smallest doc_id. Within the sets that share a part, first
each meets the one with the most neighbours. Where that leaves more than one component, the sets
outside the largest meet all others: they are cut into blocks of about BLOCK sets, pairs of blocks are
dealt to tasks, and a task compares parity bits without writing out any pair but those that pass. So
no task holds more than two blocks, pairs are not listed within a group, and any two texts that could
link either are compared or are known to be connected. A first such round takes each set's best
candidate only, which connects most of what is left; the last round takes all that pass.

Candidates are compared from their texts: pairs are dealt by their first end, at most about CELL to one
task's cell, and each cell gets that end's text once and the other ends' texts, packed. A bitmap of fixed
size over the candidates' ids lets the scan pass by other texts; where ids are too many for it, more texts
pass, and the result is the same.

Nulls: a text that is null or has no words has an empty set and is linked with nothing; a null doc_id
is linked only if texts of its very set have ids. Repeated rows count as copies; rows with one doc_id
are one node. Texts of any length are taken whole; a task holds the sets of a few texts at a time. Empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.llm.scratch import materialise, release
from seqloom.llm.text import LOWER, NON_SPACE, PIECE_BYTES, Words, column_bytes, mix, pieces, windows

#: Ratio of the bounds of a size band; parts left out, as a share of d.
BAND, SPARE = 1.5, 0.25
#: Runs in which keys are grouped, pairs with one first end in a cell, least parity bits a member.
SLICES, CELL, BITS = 4, 512, 4
#: Sets in a block of a part's members (on average, as they are dealt by hash); words of parity bits compared at once.
BLOCK, WORDS = 2048, 1 << 20
#: Pairs that are compared at once, and bits of the bitmap of ids (4 MB).
PAIRS, MARKS = 1 << 18, 1 << 25

_ONE = np.uint64(1)


class Bands:
    """Sketch sizes by size band, for a threshold of above / below."""

    def __init__(self, above: int, below: int) -> None:
        self.above, self.below = above, below
        self.ends = [1]
        while self.ends[-1] < 1 << 40:
            self.ends.append(max(int(self.ends[-1] * BAND), self.ends[-1] + 1))
        self.ends = np.array(self.ends)  # band k holds sizes from ends[k - 1] to ends[k] - 1

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.ends, n, "right"))

    def difference(self, band: int) -> int:
        """The largest difference from a similar set, if the smaller of both is in the band."""
        return (self.below - self.above) * (int(self.ends[band]) - 1) // self.above

    def bands_of(self, n: int) -> list[int]:
        """The bands in which a set of n members looks for partners: its own, and that of smaller ones."""
        own = self.band(n)
        lowest = self.band(-(-self.above * n // self.below))
        return list(range(lowest, own + 1))

    def keys(self, members: np.ndarray, band: int) -> np.ndarray:
        """One 64-bit key for each part that is not left out; equal parts have equal keys."""
        d = self.difference(band)
        if not d:
            return np.zeros(0, np.uint64)  # only equal sets are similar
        spare = int(SPARE * d)
        parts = d + 1 + spare
        part = ((members >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        sketch = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(sketch, part, members)
        kept = np.argsort(np.bincount(part, minlength=parts), kind="stable")[spare:]
        return mix(sketch[kept] ^ mix(kept.astype(np.uint64) * np.uint64(4096) + np.uint64(band)))

    def most(self, small: np.ndarray | int, large: np.ndarray | int) -> np.ndarray | int:
        """The largest difference of similar sets of these sizes."""
        return (self.below - self.above) * (small + large) // (self.below + self.above)


def parity(members: np.ndarray) -> np.ndarray:
    """The parity bits of a set as 64-bit words, a power of two of them."""
    size = 64
    while size < BITS * len(members):
        size *= 2
    odd = np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Parity bits (in the last dimension) as those of a smaller sketch."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's ascending distinct shingles of n words; fewer words are one shingle."""
    data, bounds = column_bytes(column)
    words = Words(LOWER[data], bounds, NON_SPACE)
    hashes, counts = words.hashes(), words.counts
    begins, grams = windows(hashes, words.offsets, n)
    heads = np.searchsorted(begins, words.offsets)
    short = {}
    for size in range(1, n):
        if (counts == size).any():
            at, values = windows(hashes, words.offsets, size)
            short[size] = dict(zip(at.tolist(), values, strict=True))
    for i, count in enumerate(counts.tolist()):
        if count >= n or not count:
            yield np.unique(grams[heads[i] : heads[i + 1]])
        else:
            yield np.array([short[count][int(words.offsets[i])]], np.uint64)


def _pack(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def describe(docs: DataFrame, bands: Bands, n: int) -> DataFrame:
    """doc_id, the set's size and 128-bit signature, the keys of its parts, its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, first, second, keys, bits = [], [], [], [], []
            for members in sets_of(batch.column(1), n):
                sizes.append(len(members))
                first.append(int(members.sum(dtype=np.uint64).view(np.int64)) if len(members) else 0)
                second.append(int(np.bitwise_xor.reduce(mix(members + _ONE)).view(np.int64)) if len(members) else 0)
                own = bands.bands_of(len(members)) if len(members) else []
                keys.append(np.concatenate([bands.keys(members, b) for b in own]) if own else np.zeros(0, np.uint64))
                bits.append(parity(members))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), _pack(keys), _pack(bits)],
                ["doc_id", "n", "first", "second", "keys", "bits"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, first long, second long, keys binary, bits binary")


def _part_rows(sketches: DataFrame, part: int) -> DataFrame:
    """key, node, n: a row for each key of one remainder of a set's parts that are not left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(2)]
                keys = [k[k % np.uint64(SLICES) == part] for k in keys]
                times = pa.array(np.repeat(np.arange(rows.num_rows), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), rows.column(0).take(times), rows.column(1).take(times)], ["key", "node", "n"])

    known = sketches.where(F.length("keys") > 0).select(F.col("doc_id").alias("node"), "n", "keys")
    return known.mapInArrow(run, f"key long, node {sketches.schema['doc_id'].dataType.simpleString()}, n long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key is in two rows or more, and in how many (c)."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key")


def _met(sketches: DataFrame, named: DataFrame) -> DataFrame:
    """key, node, n, c: the part rows of named nodes (node) whose key two of these have.

    Texts with one set have all of their keys in common; only one of them is named."""
    found = []
    for part in range(SLICES):
        some = materialise(_shared(_part_rows(sketches, part)).join(named, "node", "left_semi").drop("c"), "parts")
        found.append(materialise(_shared(some), "parts"))
        release(some)
    every = functools.reduce(DataFrame.unionByName, found)
    same = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    heads = every.groupBy("key").agg(F.count("*").alias("c"), *same).groupBy("c", "x0", "x1").agg(F.min("key").alias("key")).select("key")
    met = materialise(every.join(heads, "key", "left_semi"), "parts")
    release(*found)
    return met


def _passes(pairs: DataFrame, bands: Bands, id_type: str) -> DataFrame:
    """The pairs (a, b) whose parity bits allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = bands.most(batch.column(2).to_numpy(), batch.column(4).to_numpy())
            keep = []
            for x, y, limit in zip(batch.column(3), batch.column(5), most.tolist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= limit)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "na", "bits_a", "nb", "bits_b").mapInArrow(run, f"a {id_type}, b {id_type}")


class _Cells:
    """Rows of whole cells, one cell after another, and the pairs among them that parity bits allow."""

    def __init__(self, batch: pa.RecordBatch, bands: Bands) -> None:
        self.bands = bands
        self.low, self.high, self.block, self.n, self.own = (batch.column(c).to_numpy() for c in ("low", "high", "block", "n", "component"))
        key = batch.column("key").to_numpy()
        new = (key[1:] != key[:-1]) | (self.low[1:] != self.low[:-1]) | (self.high[1:] != self.high[:-1])
        self.bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("bits")]
        self.size = np.array([len(x) for x in raw])
        self.bits: dict[int, np.ndarray] = {}
        self.at: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero((self.size >= size) & (self.size <= size * 2 * bands.below // bands.above))
            self.bits[size] = np.stack([fold(raw[i], size) for i in rows])
            self.at[size] = np.full(len(key), -1)
            self.at[size][rows] = np.arange(len(rows))

    def listed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one cell, many cells together."""
        left, right, held = [], [], 0
        for low, high in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            size = high - low
            step = max(1, PAIRS // size)
            for start in range(0, size - 1, step):
                i, j = np.triu_indices(min(step, size - start), 1, size - start)
                left.append(i + (low + start))
                right.append(j + (low + start))
                held += len(i)
                if held >= PAIRS:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
        if held:
            yield np.concatenate(left), np.concatenate(right)

    def passing(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and parity distance of pairs in different components that the bits allow."""
        bands, above, below = self.bands, self.bands.above, self.bands.below
        for i, j in self.listed():
            small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            ok = (self.own[i] != self.own[j]) & (below * small >= above * large)
            ok &= (self.low[i] == self.high[i]) | (self.block[i] != self.block[j])
            i, j, most = i[ok], j[ok], bands.most(small[ok], large[ok])
            size = np.minimum(self.size[i], self.size[j])
            for b in np.unique(size).tolist():
                here = np.flatnonzero(size == b)
                step = max(1, WORDS // b)
                for low in range(0, len(here), step):
                    x, y, limit = (v[here[low : low + step]] for v in (i, j, most))
                    distance = np.bitwise_count(self.bits[b][self.at[b][x]] ^ self.bits[b][self.at[b][y]]).sum(axis=1, dtype=np.int64)
                    fits = distance <= limit
                    yield x[fits], y[fits], distance[fits]


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut between cells; rows come in the order of cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = [batch.column(c).to_numpy() for c in ("key", "low", "high")]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
        if held and all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == batch.column(c)[0].as_py() for c in ("key", "low", "high")):
            if not len(starts):
                held.append(batch)
                continue
            first = int(starts[0])
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks().to_batches()[0]
            held, batch, starts = [], batch.slice(first), starts[1:] - first
        elif held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield batch.slice(0, last)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _strays(rows: DataFrame, bands: Bands, id_type: str, best: bool) -> DataFrame:
    """Candidates (a, b) among the rows (key, node, n, component, main, bits) that share a key.

    main is one component of the key's; its rows meet the others, not each other. best: only the
    nearest candidate of each row."""
    inside = F.col("component") == F.col("main")
    blocks = rows.groupBy("key").agg(*(F.ceil(F.count(F.when(c, 1)) / BLOCK).alias(k) for k, c in (("mains", inside), ("strays", ~inside))))
    own = F.when(inside, F.pmod(F.xxhash64("node"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), "strays"))
    last = F.col("mains") + F.col("strays") - 1
    # few rows make one cell; else a block meets each block of strays
    one = last == 1
    others = F.when(F.col("block") < F.col("mains"), F.sequence(F.col("mains"), last)).otherwise(F.sequence(F.lit(0).cast("long"), last))
    cells = rows.join(blocks, "key").withColumn("block", own).withColumn("other", F.explode(F.when(one, F.array(F.col("block"))).otherwise(others)))
    cells = cells.select(
        "key", F.when(one, 0).otherwise(F.least("block", "other")).alias("low"), F.when(one, 0).otherwise(F.greatest("block", "other")).alias("high"), "block", "node", "n", "component", "bits"
    )
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_cells(batches):
            node = batch.column("node")
            for x, y, distance in _Cells(batch, bands).passing():
                if best:
                    ends = np.concatenate([x, y])
                    order = np.lexsort((np.tile(distance, 2), ends))
                    pick = order[np.concatenate([[True], ends[order][1:] != ends[order][:-1]])] % max(len(x), 1) if len(x) else order
                    x, y = x[pick], y[pick]
                if len(x):
                    yield pa.RecordBatch.from_arrays([node.take(pa.array(x)), node.take(pa.array(y))], ["a", "b"])

    found = cells.mapInArrow(run, f"a {id_type}, b {id_type}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bitmap of the nodes' hashes."""
    at = F.pmod(F.xxhash64("node"), F.lit(MARKS)) + 1
    found = nodes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in found.collect():  # at most MARKS / 32768 rows of 4 KB
        low = (r["bucket"] - 1) * 4096
        out[low : low + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, bands: Bands, n: int, id_type: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(pairs.select(F.explode(F.array("a", "b")).alias("node"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pack = marks.value, zstandard.ZstdCompressor(3).compress
        for batch in batches:
            at = batch.column(2).to_numpy()
            chosen = batch.filter(pa.array((own[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for piece in pieces(iter([chosen]), "text"):
                texts = [pack(x.as_buffer() if x.is_valid else b"") for x in piece.column(1)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.binary())], ["node", "text"])

    known = docs.select(F.col("doc_id").alias("node"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).alias("at"))
    texts = known.mapInArrow(packed, f"node {id_type}, text binary")
    dealt = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells")), "a")
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), "cells").alias("cell"), "b")
    asked = dealt.select("a", "cell", F.lit(True).alias("other"), F.col("b").alias("node"))
    asked = asked.unionByName(dealt.select("a", "cell").distinct().select("a", "cell", F.lit(False).alias("other"), F.col("a").alias("node")))
    cells = asked.join(texts, "node").repartition("a", "cell").sortWithinPartitions("a", "cell", "other").select("a", "cell", "other", "node", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, cell, firsts = zstandard.ZstdDecompressor().decompress, None, []
        for rows, column in _unpacked(batches, unpack):
            keep = []
            names = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)
            for (a, number, other), members in zip(names, sets_of(column, n), strict=True):
                if cell != (a, number):
                    cell, firsts = (a, number), []
                if not other:
                    firsts.append(members)  # one, unless rows repeat its id
                keep.append(other and any(_similar(x, members, bands) for x in firsts))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(chosen), rows.column(3).filter(chosen)], ["a", "b"])

    return materialise(cells.mapInArrow(compared, f"a {id_type}, b {id_type}"), "links")


def _unpacked(batches: Iterator[pa.RecordBatch], unpack: Callable[[bytes], bytes]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of batches with their unpacked texts (column 4), of about PIECE_BYTES."""
    for batch in batches:
        low, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(unpack(batch.column(4)[i].as_buffer()))
            size += len(texts[-1])
            if size >= PIECE_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(low, i + 1 - low), pa.array(texts, pa.binary())
                low, size, texts = i + 1, 0, []


def _similar(x: np.ndarray, y: np.ndarray, bands: Bands) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bands.below * both >= bands.above * (len(x) + len(y) - both)


def groups(docs: DataFrame, n: int = 4, above: int = 85, below: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of docs.

    Two texts link if below * |A and B| >= above * |A or B|.
    """
    bands = Bands(above, below)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = materialise(describe(docs, bands, n), "sketches")
    rows = materialise(sketches.select("doc_id", "n", "first", "second"), "sets")
    equal = rows.where("n > 0").groupBy("n", "first", "second").agg(F.min("doc_id").alias("node"))
    equal = materialise(equal, "equal")

    met = _met(sketches, equal.select("node").distinct())
    known = met.groupBy("node").agg(F.sum("c").alias("neighbours"))
    bits = sketches.where("n > 0").select(F.col("doc_id").alias("node"), "bits")
    known = materialise(known.join(bits, "node").dropDuplicates(["node"]), "neighbours")
    release(sketches)

    def with_bits(pairs: DataFrame) -> DataFrame:
        left, right = known.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), known.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"))
        return materialise(_passes(pairs.join(left, "a").join(right, "b"), bands, id_type), "candidates")

    fit = lambda x, y: below * F.least(x, y) >= above * F.greatest(x, y)
    ranked = met.join(known.select("node", "neighbours"), "node")
    centers = ranked.groupBy("key").agg(F.max(F.struct("neighbours", "node", "n")).alias("m")).select("key", F.col("m.node").alias("a"), F.col("m.n").alias("na"))
    first = met.join(centers, "key").where((F.col("a") != F.col("node")) & fit(F.col("n"), F.col("na")))
    first = with_bits(first.select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).distinct())
    links = _verified(first, docs, bands, n, id_type)
    made = [links]
    release(first)
    labels = components(links)

    for best in (True, False):
        placed = met.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        open_keys = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("greatest")).where("least <> greatest").select("key")
        mains = centers.select("key", F.col("a").alias("center")).join(labels, F.col("center") == F.col("node"), "left")
        mains = open_keys.join(mains.select("key", F.coalesce("component", "center").alias("main")), "key")
        placed = placed.join(mains, "key").join(known.select("node", "bits"), "node")
        found = materialise(_strays(placed, bands, id_type, best), "candidates")
        if found.isEmpty():
            break
        more = _verified(found, docs, bands, n, id_type)
        made.append(more)
        release(found)
        if not more.isEmpty():
            links = links.unionByName(more)
            release(labels)
            labels = components(links)

    release(known, met)
    names = equal.join(labels, "node", "left").select("n", "first", "second", F.coalesce("component", "node").alias("component"))
    found = rows.join(names, ["n", "first", "second"], "left")
    out = materialise(found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "components")
    release(rows, equal, labels, *made)
    return out
