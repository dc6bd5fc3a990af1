"""Operator 1: scoring by a probabilistic suffix tree over words, learned from the whole corpus.

Contexts are the last words before a word, DEPTH at most. A context is a state of the tree if it occurs
LEAST_COUNT times and its next-word distribution diverges from that of the context shorter by its first
word: the likelihood ratio (in nats, over all its occurrences) is at least DIVERGENCE for each distinct
next word. A state's distribution is smoothed by that of the next shorter state (Witten and Bell's
weights), the empty context's by adding one. Each word is scored in the longest suffix of what comes
before it that is a state; texts begin with a start mark and end with an end token.

The tree is never in one place. Texts are packed in blocks of about BLOCK tokens. Each block asks for the
corpus counts of its distinct words, pairs, triples and so on, with its own counts; the requests are dealt
by hash to buckets, which add up the counts of all blocks and answer each block. A gram of three words or
more is asked for only where all of its words but the last occur LEAST_COUNT times, and fewer times than
without the first word; else they are no state, and in the second case the gram occurs as often as without
its first word. So longer levels cost less. With each answer goes whether the block owns the gram: one block
that has learned from it does. For its own grams a block adds one next word and the term of the divergence
to their contexts; these sums are added up in buckets in the same way. A gram's term is rounded to whole
parts of 1 / UNIT nat before it is added, so that all sums are of whole numbers and exact, whatever the
blocks are. A key takes one entry a block however often it
occurs, and no task holds more than a block or a bucket. Requests are a row for each block and bucket that
have keys in common, so that a row holds one key at worst; larger blocks make fewer entries.

Words and grams are known by 64-bit hashes, so counts are exact but for chance (2**-64 a pair).

Nulls: a null text is empty and has the end token only. A null id is never learned from and counts as
held out. Repeated rows are learned from and answered each. A text longer than a block is a block by
itself. Nothing to learn from gives score 0 to all texts. Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.scratch import bucketed, materialise, release
from seqloom.llm.text import LOWER, NON_SPACE, Words, column_bytes, mix, pieces

BLOCK, BUCKET_BYTES, LEAST_BUCKETS = 1 << 20, 4 << 20, 64
#: Words of the longest contexts, occurrences that a state must have, nats for each distinct next word.
DEPTH, LEAST_COUNT, DIVERGENCE = 4, 2, 2.0
#: Parts of a nat in which terms of the divergence are counted.
UNIT = 1024

_END, _START = np.uint64(0x9D3F2C5A71B8E601), np.uint64(0x5B1C7E92A4D0F387)
_STEP = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "block long, bucket int, part binary, owned long"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: remainder 2 of its id's CRC-32 by 7; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def _ipc(batch: pa.RecordBatch, compression: str | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(rows: list[pa.RecordBatch], words: list[np.ndarray], sizes: list[np.ndarray]) -> bytes:
    """A block: doc_id, held_out and number of tokens of its rows, its distinct tokens (the most frequent
    first, the start mark last) and each token's place among these, byte by byte."""
    counts = np.concatenate(sizes)
    token = np.full(int(counts.sum() + len(counts)), _END)
    token[np.arange(len(token) - len(counts)) + np.repeat(np.arange(len(counts)), counts)] = np.concatenate(words)
    found, place, often = np.unique(token, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T)
    table = pa.Table.from_batches(rows).append_column("n", pa.array(counts + 1)).combine_chunks().to_batches()[0]
    names = ["rows", "tokens", "p0", "p1", "p2", "p3"]
    parts = [_ipc(table), np.append(found[order], _START).tobytes(), *(p.tobytes() for p in planes)]
    return _ipc(pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names), "zstd")


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, bucket (-1), part (a packed block), owned (0), bytes (of its texts), learned (its training tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        rows, words, sizes, held = [], [], [], 0
        volume = learned = 0

        def row() -> pa.RecordBatch:
            values = [task + number, -1, _packed(rows, words, sizes), 0, volume, learned]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "bucket", "part", "owned", "bytes", "learned"])

        for piece in pieces(batches, "text"):
            data, bounds = column_bytes(piece.column(2))
            own = Words(LOWER[data], bounds, NON_SPACE)
            if held and held + len(own) > size:
                yield row()
                rows, words, sizes, held, number = [], [], [], 0, number + 1
                volume = learned = 0
            rows.append(pa.RecordBatch.from_arrays(piece.columns[:2], ["doc_id", "held_out"]))
            words.append(own.hashes())
            sizes.append(own.counts)
            held += len(own) + len(own.counts)
            volume += len(data)
            learned += int((own.counts + 1)[~piece.column(1).to_numpy(zero_copy_only=False).astype(bool)].sum())
        if rows:
            yield row()

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, _SCHEMA + ", bytes long, learned long")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse. Sorting keys' high bits with positions in the low ones is much faster
    than sorting positions; in the rare case that high bits tie out of order, it is done the usual way."""
    n = len(keys)
    if n < 2:
        return np.unique(keys, return_inverse=True)
    inner = keys - keys.min()
    width = np.uint64(int(n - 1).bit_length())
    spare = np.uint64(max(0, 64 - int(inner.max()).bit_length()))
    packed = np.sort((inner << spare) >> width << width | np.arange(n, dtype=np.uint64))
    order = (packed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(keys, return_inverse=True)
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def _write_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, then the steps in six bytes each if all are that small."""
    steps = np.diff(keys)
    if len(steps) and int(steps.max()) >> 48 == 0:
        return keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return keys.tobytes()


def _read_keys(raw: np.ndarray, n: int) -> np.ndarray:
    if len(raw) == 8 * n:
        return raw.copy().view(np.uint64)
    wide = np.zeros((n, 8), np.uint8)
    wide[0] = raw[:8]
    wide[1:, :6] = raw[8:].reshape(-1, 6)
    return np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64)


def _write_numbers(values: np.ndarray) -> bytes:
    """Whole numbers, a byte each; 255 stands for one of those listed in full at the end."""
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype(np.int64).tobytes()


def _read_numbers(raw: np.ndarray, n: int) -> np.ndarray:
    values = raw[:n].astype(np.int64)
    if len(raw) > n:
        values[values == 255] = raw[n:].copy().view(np.int64)
    return values


def _write_signed(values: np.ndarray) -> bytes:
    """Whole numbers in two bytes each; 32767 stands for one of those listed in full at the end."""
    large = np.abs(values) >= 32767
    return np.where(large, 32767, values).astype(np.int16).tobytes() + values[large].tobytes()


def _read_signed(raw: np.ndarray, n: int) -> np.ndarray:
    values = raw[: 2 * n].copy().view(np.int16).astype(np.int64)
    if len(raw) > 2 * n:
        values[values == 32767] = raw[2 * n :].copy().view(np.int64)
    return values


def _join(n: int, *parts: bytes) -> bytes:
    return b"".join([np.array([n, *map(len, parts)], np.int64).tobytes(), *parts])


def _split(raw: pa.Scalar, parts: int) -> tuple[int, list[np.ndarray]]:
    """What _join() joined."""
    data = np.frombuffer(raw.as_buffer(), np.uint8)
    n, *sizes = data[: 8 * (parts + 1)].copy().view(np.int64).tolist()
    ends = np.cumsum([8 * (parts + 1), *sizes])
    return n, [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Block:
    """The tokens of a block; its grams and their corpus counts as far as answers to them are known.

    Position i of a block is a token; a gram of level m is the m tokens that end there. A level has the
    positions where a gram is asked for, the ascending distinct keys of these grams, each position's
    place among the keys, and from the answers the keys' counts and which of them the block owns."""

    def __init__(self, part: pa.Scalar, buckets: int, answers: dict[int, list[np.ndarray]] | None = None, levels: int = 0) -> None:
        packed = pa.ipc.open_stream(part.as_buffer()).read_all()
        raw = [packed.column(i)[0].as_buffer() for i in range(6)]
        self.buckets, self.answers = buckets, answers or {}
        self.rows = pa.ipc.open_stream(raw[0]).read_all().combine_chunks()
        sizes = self.rows.column("n").to_numpy()
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.held = self.rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.train = np.repeat(~self.held, sizes)
        self.place = np.ascontiguousarray(np.stack([np.frombuffer(r, np.uint8) for r in raw[2:]], axis=1)).view(np.uint32).ravel().astype(np.int64)
        self.tokens = np.frombuffer(raw[1], np.uint64)
        #: how many tokens of its text stand before each one
        self.at = np.arange(len(self.place)) - np.repeat(self.offsets[:-1], sizes)
        self.start = len(self.tokens) - 1  # the start mark's place
        self.sums = self.tokens[self.place] * _STEP[0]
        keys = mix(self.tokens * _STEP[0] + np.uint64(1))
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.start = int(rank[self.start])
        self.end = int(rank[np.flatnonzero(self.tokens == _END)[0]])
        self.positions, self.keys, self.places = [np.arange(len(self.place))], [keys[order]], [rank[self.place]]
        self.same = [np.zeros(0, np.int64)] * 2  # by level: positions where the gram occurs as often as without its first token
        #: by level: counts of keys and which are owned; counts of the grams at all positions; places (-1 for none)
        self.counts: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []
        self.here: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        for level in range(levels):
            if level:
                self._next()
            self._counted(level)

    def _next(self) -> None:
        """Add the positions and keys of the next level."""
        m = len(self.keys) + 1  # tokens in a gram
        if m == 2:
            positions = self.positions[0]
        else:
            # all but the gram's last token occur often enough, and at most one start mark is among them
            before = np.zeros(len(self.at), bool)
            before[1:] = self.here[m - 2][:-1] >= LEAST_COUNT
            positions = np.flatnonzero(before & (self.at >= max(m - 2, 1)))
        earlier = positions - (m - 1)
        token = np.where(self.at[positions] >= m - 1, self.tokens[self.place[earlier]], _START)
        self.sums[positions] += token * _STEP[m - 1]
        if m > 2:
            same = self.here[m - 2][positions - 1] == self.here[m - 3][positions - 1]
            self.same.append(positions[same])
            positions = positions[~same]
        found, place = distinct(mix(self.sums[positions] + np.uint64(m)))
        self.positions.append(positions)
        self.keys.append(found)
        self.places.append(place)

    def _counted(self, level: int) -> None:
        """Take the answers to a level."""
        n = len(self.keys[level])
        counts, owned = np.zeros(n, np.int64), np.zeros(n, bool)
        low = 0
        for raw in self.answers.get(level, ()):
            size, (numbers, flags) = _split(raw, 2)
            counts[low : low + size] = _read_numbers(numbers, size)
            owned[low : low + size] = np.unpackbits(flags, count=size)
            low += size
        self.counts.append(counts)
        self.owned.append(owned)
        here, where = np.zeros(len(self.at), np.int64), np.full(len(self.at), -1)
        here[self.positions[level]] = counts[self.places[level]]
        if level > 1:
            here[self.same[level]] = self.here[level - 1][self.same[level]]
        where[self.positions[level]] = self.places[level]
        self.here.append(here)
        self.where.append(where)

    def ask(self, number: int, level: int) -> Iterator[pa.RecordBatch]:
        """Requests for the counts of a level, with the block's own counts."""
        if level == len(self.keys):
            self._next()
        own = np.bincount(self.places[level], self.train[self.positions[level]], len(self.keys[level])).astype(np.int64)
        yield from self._requests(number, level, self.keys[level], lambda i, j: [_write_numbers(own[i:j])])

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions with a context of k tokens that may be a state, its place among level k's keys, and its count."""
        positions = self.positions[k]
        first = self.at[positions] == 0
        place = np.where(first, self.start, self.where[k - 1][positions - 1])
        count = np.where(first, self.counts[0][self.end], self.here[k - 1][positions - 1])
        chosen = count >= LEAST_COUNT
        return positions[chosen], place[chosen], count[chosen]

    def tell(self, number: int, depth: int, k: int, n: int) -> Iterator[pa.RecordBatch]:
        """Requests for the contexts of k tokens, with next words and divergence of the grams that the block owns."""
        positions, context, count = self.contexts(k)
        gram = self.where[k][positions]
        one = np.full(len(self.keys[k]), -1)
        one[gram] = np.arange(len(positions))  # a position of each gram
        one = one[(one >= 0) & self.owned[k]]
        at, context_of, total = positions[one], context[one], self.here[k][positions[one]]
        if k == 1:
            shorter = self.here[0][at] / max(n, 1)
        else:
            shorter = self.here[k - 1][at] / self.here[k - 2][at - 1]
        terms = np.rint(UNIT * total * np.log(total / count[one] / shorter))
        size = len(self.keys[k - 1])
        asked = np.zeros(size, bool)
        asked[context] = True
        asked = np.flatnonzero(asked)
        following = np.bincount(context_of, minlength=size)[asked]
        gain = np.bincount(context_of, terms, size)[asked].astype(np.int64)
        keys = self.keys[k - 1][asked]
        yield from self._requests(number, depth + k, keys, lambda i, j: [_write_numbers(following[i:j]), _write_signed(gain[i:j][following[i:j] > 0])])

    def following(self, depth: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions with a state of k tokens, its number of next words and its count."""
        positions, context, count = self.contexts(k)
        asked = np.zeros(len(self.keys[k - 1]), np.int64)
        asked[context] = 1
        found = [_split(raw, 1) for raw in self.answers.get(depth + k, ())]
        asked[asked > 0] = np.concatenate([_read_numbers(numbers, size) for size, (numbers,) in found]) if found else 0
        weight = asked[context]
        state = weight > 0
        return positions[state], weight[state], count[state]

    def _requests(self, number: int, kind: int, keys: np.ndarray, values: Callable[[int, int], list[bytes]]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket that has any of the ascending keys. Buckets are equal ranges of keys."""
        if not len(keys):
            return
        bucket = ((keys >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        names, heads = np.unique(bucket, return_index=True)
        parts = [_join(j - i, _write_keys(keys[i:j]), *values(i, j)) for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True)]
        columns = [pa.array(np.full(len(names), number)), pa.array(names + kind * self.buckets, pa.int32()), pa.array(parts, pa.binary()), pa.array(np.zeros(len(names), np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "part", "owned"])

    def by_text(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[self.offsets])


def _counted(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key's sum over all requests, and whether this entry is the first one of its key that is not 0."""
    found, place = distinct(keys)
    own = np.concatenate(values)
    total = np.bincount(place, own, len(found)).astype(np.int64)
    some = np.flatnonzero(own)[::-1]
    first = np.full(len(found), -1)
    first[place[some]] = some
    owner = np.zeros(len(keys), bool)
    owner[first[first >= 0]] = True
    return total[place], owner


def _exchange(requests: DataFrame, buckets: int, depth: int) -> DataFrame:
    """Add up the values of equal keys over all blocks, and answer each request in its order."""

    def run(table: pa.Table) -> pa.Table:
        gram = table.column("bucket")[0].as_py() // buckets <= depth
        table = table.sort_by("block")
        raw = [_split(p, 2 if gram else 3) for p in table.column("part")]
        sizes = [n for n, _ in raw]
        keys = np.concatenate([_read_keys(parts[0], n) for n, parts in raw])
        values = [_read_numbers(parts[1], n) for n, parts in raw]
        ends = np.cumsum(sizes)
        if gram:
            total, owner = _counted(keys, values)
            parts = [_join(n, _write_numbers(total[e - n : e]), np.packbits(owner[e - n : e]).tobytes()) for e, n in zip(ends, sizes, strict=True)]
            owned = np.add.reduceat(owner.astype(np.int64), ends - sizes)
        else:
            found, place = distinct(keys)
            following = np.concatenate(values)
            some = following > 0
            gains = [_read_signed(p[2], np.count_nonzero(v)) for (_, p), v in zip(raw, values, strict=True)]
            gain = np.bincount(place[some], np.concatenate(gains), len(found))
            following = np.bincount(place, following, len(found)).astype(np.int64)
            state = np.where(gain >= DIVERGENCE * UNIT * following, following, 0)[place]
            parts = [_join(n, _write_numbers(state[e - n : e])) for e, n in zip(ends, sizes, strict=True)]
            owned = np.zeros(len(sizes), np.int64)
        out = pa.table([table.column("block"), table.column("bucket"), pa.array(parts, pa.binary()), pa.array(owned)], ["block", "bucket", "part", "owned"])
        return out.cast(table.schema)

    return requests.groupBy("bucket").applyInArrow(run, _SCHEMA)


def scores(docs: DataFrame, depth: int = DEPTH, size: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    depth: words of the longest contexts; size: tokens of a block, which changes no result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed = bucketed(blocks(docs, size), "blocks", "block")
    sums = packed.agg(F.sum("bytes"), F.sum("learned")).first()
    n, buckets = sums[1] or 0, max(LEAST_BUCKETS, int(sums[0] or 0) // BUCKET_BYTES)
    texts = packed.select("block", "bucket", "part", "owned")

    def visit(answers: DataFrame, levels: int, act: Callable[[int, Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``act`` gives for each block. Blocks and answers are stored by block, so that neither is shuffled."""

        def run(block: pa.Table, answered: pa.Table) -> pa.Table:
            rows = sorted(zip(answered.column("bucket").to_pylist(), answered.column("part"), strict=True), key=lambda r: r[0])
            known: dict[int, list[pa.Scalar]] = {}
            for bucket, part in rows:
                known.setdefault(bucket // buckets, []).append(part)
            own = Block(block.column("part")[0], buckets, known, levels)
            out = list(act(block.column("block")[0].as_py(), own))
            return pa.Table.from_batches(out) if out else nothing

        nothing = pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.int64())], ["block", "bucket", "part", "owned"])
        return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                block = Block(part, buckets)
                yield from block.ask(number, 0)
                yield from block.ask(number, 1)

    answers = bucketed(_exchange(texts.mapInArrow(first, _SCHEMA), buckets, depth), "answers", "block")
    v = answers.where(F.col("bucket") < buckets).agg(F.sum("owned")).first()[0] or 0

    for level in range(2, depth + 2):

        def further(number: int, block: Block, level: int = level) -> Iterator[pa.RecordBatch]:
            if level <= depth:
                yield from block.ask(number, level)
            yield from block.tell(number, depth, level - 1, n)

        # the states of contexts are not needed before the scores
        counts = answers.where(F.col("bucket") < (depth + 1) * buckets)
        answers = bucketed(_exchange(visit(counts, level, further, _SCHEMA), buckets, depth), "answers", "block", answers)

    def score(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        p = (block.here[0] + 1) / (n + v + 1)
        base = block.by_text(np.log10(p))
        for k in range(1, depth + 1):
            at, weight, count = block.following(depth, k)
            p[at] = (block.here[k][at] + weight * p[at]) / (count + weight)
        rows = block.rows
        columns = [
            rows.column("doc_id").combine_chunks(),
            pa.array(block.held),
            pa.array(np.diff(block.offsets)),
            pa.array(block.by_text((block.here[0] > 0).astype(np.int64))),
            pa.array(np.full(len(rows), n, np.int64)),
            pa.array(base),
            pa.array(block.by_text(np.log10(p))),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = materialise(visit(answers, depth + 1, score, schema), "scores")
    release(packed, answers)
    return out
