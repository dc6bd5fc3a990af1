"""Operator 4: benchmark decontamination by a distributed positional inverted index.

build_index() stores, for segments of about two megabytes of text, the sorted terms (64-bit hashes of
words) and each term's ascending positions in the segment; one position is left free between
documents, so that a phrase never crosses a bound. Segments are rows of a table in the shared folder.
A phrase is found by starting from the postings of its rarest term (by counts over the whole index),
shifting them to where the phrase would begin, and intersecting them with the shifted postings of its
other terms, rarest first. Queries are taken in blocks of a bounded number of windows; each block
meets all segments, and the hits of all blocks are joined by document.

Nulls: a null text has no words; a null document id stays null, each row of documents is answered on
its own, also repeated ones. A null item text has no window; a null item id counts as the empty
string. Empty tables give empty results. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.scratch import materialise
from seqloom.llm.text import ALPHANUMERIC, LOWER, Words, column_bytes, pieces

#: Windows that one block of queries holds at most (on average, as they are dealt by hash): 16 MB of terms.
BLOCK_WINDOWS = 200_000
WINDOW = 10



def words_of(batch: pa.RecordBatch, column: int = 1) -> Words:
    data, bounds = column_bytes(batch.column(column))
    return Words(LOWER[data], bounds, ALPHANUMERIC)


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each segment: its documents, and its postings packed in three arrays.

    segment: a number, fixed once the index is written. doc_ids, n_words: for each document, in order. terms: ascending uint64. heads: where the postings
    of each term begin, int32, and their number last. positions: int32; document i begins at position
    sum(n_words[:i]) + i.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(pieces(batches, "text")):
            words = words_of(batch)
            hashes = words.hashes()
            order = np.argsort(hashes, kind="stable")
            terms, heads = np.unique(hashes[order], return_index=True)
            positions = (order + words.text_index[order]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(words.counts, pa.int32())),
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([np.append(heads, len(hashes)).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([positions.tobytes()], pa.binary()),
                ],
                ["segment", "doc_ids", "n_words", "terms", "heads", "positions"],
            )

    schema = f"segment long, doc_ids array<{id_type}>, n_words array<int>, terms binary, heads binary, positions binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Segment:
    """The postings of one row of the index."""

    def __init__(self, terms: bytes, heads: bytes, positions: bytes) -> None:
        self.terms = np.frombuffer(terms, np.uint64)
        self.heads = np.frombuffer(heads, np.int32)
        self.positions = np.frombuffer(positions, np.int32)

    def lookup(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms; -1 where a term does not occur."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.heads[place] : self.heads[place + 1]]

    def phrase(self, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Where a phrase begins; order: its offsets, the rarest term first."""
        found = self.postings(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            own = self.postings(places[k]) - k
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            found = found[own[at] == found]
        return found

    def near(self, places: np.ndarray, order: np.ndarray, slop: int, gaps: np.ndarray) -> np.ndarray:
        """Positions of the rarest term that have all other terms at most ``slop`` away in their document.

        gaps: the free positions after each document."""
        found = self.postings(places[order[0]])
        low = np.concatenate([[-1], gaps])[np.searchsorted(gaps, found)]
        high = gaps[np.searchsorted(gaps, found)]
        keep = np.ones(len(found), bool)
        for k in order[1:]:
            own = self.postings(places[k])
            first = np.searchsorted(own, np.maximum(found - slop, low + 1))
            ok = first < len(own)
            ok[ok] = own[first[ok]] <= np.minimum(found + slop, high - 1)[ok]
            keep &= ok
        return found[keep]


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item (string) and terms (array of long) for each window; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 18):
            words = words_of(batch)
            hashes = words.hashes().view(np.int64)
            names, values, lengths = [], [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                low, high = words.offsets[i], words.offsets[i + 1]
                for at in range(low, max(high - size, low) + (high > low)):
                    names.append(name)
                    values.append(hashes[at : min(at + size, high)])
                    lengths.append(len(values[-1]))
            if names:
                heads = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(heads), pa.array(np.concatenate(values)))], ["item", "terms"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "item string, terms array<long>")


def _block(windows: DataFrame, k: int, blocks: int) -> tuple[list[str], list[np.ndarray]]:
    """The windows of one block; their number is bounded by how many blocks there are."""
    own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == k)
    found = own.toArrow()
    return found.column(0).to_pylist(), [np.array(x, np.int64).view(np.uint64) for x in found.column(1).to_pylist()]


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the given terms occurs in the whole index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                segment = Segment(a.as_buffer(), b.as_buffer(), b"")
                at = segment.lookup(terms)
                has = at >= 0
                total[has] += np.diff(segment.heads)[at[has]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["term", "n"])

    rows = index.select("terms", "heads").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _match(index: DataFrame, names: list[str], queries: list[np.ndarray], id_type: str) -> DataFrame:
    """For each document: the positions inside occurrences of any window, and the items of those windows."""
    terms = np.unique(np.concatenate(queries)) if queries else np.zeros(0, np.uint64)
    counts = term_counts(index, terms) if queries else np.zeros(0, np.int64)
    sizes = np.array([len(q) for q in queries])
    groups = []  # by length: the windows' numbers, their terms as places in ``terms``, offsets from the rarest on
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        place = np.searchsorted(terms, np.stack([queries[i] for i in which]))
        groups.append((which, place, np.argsort(counts[place], axis=1, kind="stable")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, n_words = batch.column(0)[row].values, batch.column(1)[row].values.to_numpy()
                segment = Segment(*(batch.column(c)[row].as_buffer() for c in (2, 3, 4)))
                first = np.concatenate([[0], np.cumsum(n_words + 1)])
                hits: dict[int, set[int]] = {}
                items: dict[int, set[str]] = {}
                at = segment.lookup(terms)
                for which, place, order in groups:
                    here = at[place]
                    for w in np.flatnonzero((here >= 0).all(axis=1)):
                        begins = segment.phrase(here[w], order[w])
                        for doc, begin in zip(np.searchsorted(first, begins, "right") - 1, begins, strict=True):
                            low = int(begin - first[doc])
                            hits.setdefault(int(doc), set()).update(range(low, low + place.shape[1]))
                            items.setdefault(int(doc), set()).add(names[which[w]])
                n = len(n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(5)[row].as_py())),
                        pa.array(np.arange(n)),
                        doc_ids,
                        pa.array(n_words.astype(np.int64)),
                        pa.array([sorted(hits.get(i, ())) for i in range(n)], pa.list_(pa.int32())),
                        pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    ],
                    ["segment", "place", "doc_id", "n_words", "hits", "items"],
                )

    schema = f"segment long, place long, doc_id {id_type}, n_words long, hits array<int>, items array<string>"
    return index.select("doc_ids", "n_words", "terms", "heads", "positions", "segment").mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, n_items, items (sorted names), contaminated.

    docs has doc_id and text, items has item_id and text. A word is hit if it lies in an occurrence of
    ten consecutive words of an item (of the whole item, if that is shorter).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    index = materialise(build_index(docs), "positions")
    windows = materialise(item_windows(items), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    found = None
    for k in range(blocks):
        part = _match(index, *_block(windows, k, blocks), id_type)
        found = part if found is None else found.unionByName(part)

    def whole(name: str) -> Column:
        return F.col(name) if blocks == 1 else F.array_distinct(F.flatten(F.collect_list(name)))

    if blocks == 1:
        found = found.select("doc_id", "n_words", "hits", "items")
    else:
        found = found.groupBy("segment", "place", "doc_id", "n_words").agg(whole("hits").alias("hits"), whole("items").alias("items"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def near(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """Proximity search: doc_id and position of each occurrence of the rarest term with all others within ``slop``."""
    field = index.schema["doc_ids"].dataType.elementType.simpleString()
    if not terms:
        return index.sparkSession.createDataFrame([], f"doc_id {field}, position long")
    data, bounds = column_bytes(pa.array(terms))
    hashes = Words(LOWER[data], bounds, ALPHANUMERIC).hashes()
    if len(hashes) != len(terms):
        raise ValueError("each term must be one word")
    known = np.unique(hashes)
    order = np.argsort(term_counts(index, known)[np.searchsorted(known, hashes)], kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n_words = batch.column(1)[row].values.to_numpy()
                segment = Segment(*(batch.column(c)[row].as_buffer() for c in (2, 3, 4)))
                places = segment.lookup(hashes)
                if (places < 0).any():
                    continue
                first = np.concatenate([[0], np.cumsum(n_words + 1)])
                at = segment.near(places, order, slop, first[1:] - 1)
                doc = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values.take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int64))], ["doc_id", "position"])

    return index.select("doc_ids", "n_words", "terms", "heads", "positions").mapInArrow(run, f"doc_id {field}, position long")
