"""Operator 9: byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

A prefix of the input has one BPE encoding, whose last token is the only one that may follow the
encoding of what stands before it (a pair may follow when encoding its joined bytes gives the pair
back). A state is the last emitted token and the bytes read since. Reading a byte extends the last
tokens of all prefixes; what every start that a longer token could still have agrees on is emitted.
Arcs are made from states that have been left WANTED times; where one is missing, the rest of the pre-token
is searched for tokens that may follow one another, the longest ones first (only one sequence of them
fits), which costs less than an arc that nothing else uses. States are forgotten together when there are
too many. The ids of recent pre-tokens are kept; digests look ids up for many texts at once, and take
both the decimals and the decoded bytes from the ids.

Nulls are empty texts; an empty text has no tokens and the hashes of the empty string. Texts of any
length are read in runs of pre-tokens, so memory follows the longest pre-token, not the text. Null ids
and repeated rows are answered each as they are. Empty tables give empty results; columns other than
doc_id and text are not read by digests(), and are kept by encode() and decode(), which replace a
column of the result's name.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.text import give_back, pieces

MAX_STATES, WANTED = 250_000, 100
#: Pre-tokens whose ids are kept until all are forgotten.
MAX_WORDS = 600_000
RUN = 1 << 16


class _State:
    __slots__ = ("before", "pending", "last", "live", "arcs", "left")

    def __init__(self, before: int, pending: bytes, last: tuple, live: tuple) -> None:
        self.before = before  # the token before the pending bytes; -1 at the start
        self.pending = pending
        self.last = last  # for each prefix of pending: its last token, where that begins, all token ends as bits
        self.live = live  # where a token may begin that has all bytes from there and perhaps more; its place in the trie
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.left = 0  # how often an arc was missing


class Transducer:
    """Encodes one pre-token at a time: bytes in, ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.trie: dict[int, int] = {}  # place * 256 + byte to place; 0 is the root
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                at = self.trie.setdefault(at << 8 | byte, len(self.trie) + 1)
            self.token_at[at] = rank
        self.states: dict[tuple[int, bytes], _State] = {}
        self.follows: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})

    @classmethod
    def from_file(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of a token while it is merged, and the rank of the merge that takes it up."""
        found = self.edges[side].get(token)
        if found is None:
            halves = self._halves(token)
            if halves is None:
                found = [(token, 1 << 40)]
            else:
                inner = self._edge(halves[side], side)
                found = [*inner[:-1], (inner[-1][0], self.ranks[token]), (token, 1 << 40)]
            self.edges[side][token] = found
        return found

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether no merge crosses the bound: each side's own merges come first, the left one's on a tie."""
        pair = before << 32 | token
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) > MAX_STATES:
                self.follows.clear()
            left, right = self._edge(self.bytes_of[before], 1), self._edge(self.bytes_of[token], 0)
            i = j = 0
            known = True
            while True:
                (a, next_a), (b, next_b) = left[i], right[j]
                across = self.ranks.get(a + b, 1 << 40)
                if across < next_a and across <= next_b and across < 1 << 40:
                    known = False
                    break
                if next_a == next_b == 1 << 40:
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            self.follows[pair] = known
        return known

    def _state(self, before: int, pending: bytes, last: tuple, live: tuple) -> _State:
        found = self.states.get((before, pending))
        if found is None:
            if len(self.states) >= MAX_STATES:
                for s in self.states.values():
                    s.arcs.clear()
                self.states.clear()
            found = self.states[before, pending] = _State(before, pending, last, live)
        return found

    def _arc(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        last, before, trie = state.last, state.before, self.trie
        n, live, own, agreed = len(last) + 1, [], None, -1
        for i, place in state.live:
            place = trie.get(place << 8 | byte)
            if place is None:
                continue
            if i:
                token_before, _, ends = last[i - 1]
            else:
                token_before, ends = before, 1
            live.append((i, place))
            agreed &= ends
            if own is None:
                token = self.token_at.get(place)
                if token is not None and (token_before < 0 or self._may_follow(token_before, token)):
                    own = (token, i, ends | 1 << n)
        cut = (agreed & own[2]).bit_length() - 1
        live.append((n, 0))
        last = (*last, own)
        if cut:
            out = self._back(last, cut)
            pending = (state.pending + bytes((byte,)))[cut:]
            last = tuple([(t, i - cut, m >> cut) for t, i, m in last[cut:]])
            arc = self._state(out[-1], pending, last, tuple([(i - cut, at) for i, at in live])), out
        else:
            arc = self._state(before, state.pending + bytes((byte,)), last, tuple(live)), ()
        state.arcs[byte] = arc
        return arc

    @staticmethod
    def _back(last: tuple | list, at: int) -> tuple[int, ...]:
        out = []
        while at:
            token, at, _ = last[at - 1]
            out.append(token)
        return tuple(reversed(out))

    def encode(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        state, out = self._state(-1, b"", (), ((0, 0),)), []
        for i, byte in enumerate(data):
            arc = state.arcs.get(byte)
            if arc is None:
                state.left += 1
                if state.left < WANTED:
                    out.extend(self._rest(state, data[i:]))
                    return tuple(out)
                arc = self._arc(state, byte)
            state, emitted = arc
            if emitted:
                out.extend(emitted)
        out.extend(self._back(state.last, len(state.pending)))
        return tuple(out)

    def _rest(self, state: _State, data: bytes) -> tuple[int, ...]:
        """What is emitted from a state on, if ``data`` is all that follows; makes no states."""
        data, left, at = state.pending + data, state.before, 0
        step, token_at, follows, n = self.trie.get, self.token_at.get, self.follows.get, len(data)
        out: list[int] = []
        tried: list[tuple[int, int, list]] = []
        dead = set()  # places that no end can be reached from
        while at < n:
            place, found = 0, []
            for i in range(at, n):
                place = step(place << 8 | data[i])
                if place is None:
                    break
                token = token_at(place)
                if token is not None:
                    found.append((token, i + 1))
            while True:
                while found:
                    token, end = found.pop()
                    if end in dead:
                        continue
                    fits = left < 0 or follows(left << 32 | token)
                    if fits or fits is None and self._may_follow(left, token):
                        break
                else:
                    dead.add(at)
                    at, left, found = tried.pop()
                    out.pop()
                    continue
                break
            tried.append((at, left, found))
            out.append(token)
            at, left = end, token
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8 decoding. The state is the bytes of a character that is not yet complete."""

    def __init__(self) -> None:
        self.partial = b""

    @staticmethod
    def _wanted(lead: int) -> int:
        return 1 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF5 else 1

    @staticmethod
    def _second(lead: int) -> tuple[int, int]:
        """Bounds of the byte after ``lead``: no overlong forms, surrogates or values over 10FFFF."""
        return (0xA0 if lead == 0xE0 else 0x90 if lead == 0xF0 else 0x80, 0x9F if lead == 0xED else 0x8F if lead == 0xF4 else 0xBF)

    def _open(self, data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self._wanted(byte) <= back:
                    return 0
                low, high = self._second(byte)
                return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        """The characters that ``data`` completes; bytes that cannot be part of one give U+FFFD."""
        data = self.partial + data
        keep = self._open(data)
        self.partial = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.partial = self.partial, b""
        return rest.decode("utf-8", "replace")


class _Recent:
    """The ids of recent pre-tokens, end to end in one array; a pre-token has a number from 1 on."""

    def __init__(self, make: Callable[[str], tuple]) -> None:
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _add(self, word: str) -> int:
        self.ids.extend(self.make(word))
        number = self.numbers[word] = len(self.ends)
        self.ends.append(len(self.ids))
        return number

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        if len(self.numbers) > MAX_WORDS:
            self.forget()
        known, add = self.numbers.get, self._add
        at = np.array([known(w) or add(w) for w in words], np.int64)
        ends = np.frombuffer(self.ends, np.int64)
        low, high = ends[at - 1], ends[at]
        return np.frombuffer(self.ids, np.uint32)[_ragged(low, high - low)] if self.ids else np.zeros(0, np.uint32), high - low


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ..., then those of starts[1], and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Digest:
    """The running digests of one text's ids and of what they decode to."""

    def __init__(self) -> None:
        self.n, self.written, self.decoded, self.machine = 0, hashlib.sha256(), hashlib.sha256(), Utf8Machine()

    def feed(self, n: int, names: bytes, raw: bytes) -> None:
        """n ids, each written with a space before it, and their bytes."""
        self.written.update(names if self.n else names[1:])
        self.decoded.update(self.machine.feed(raw).encode())
        self.n += n

    def result(self) -> tuple[int, str, str]:
        self.decoded.update(self.machine.finish().encode())
        return self.n, self.written.hexdigest(), self.decoded.hexdigest()


class Codec:
    """A pre-token pattern and a transducer, with the ids of recent pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        self.transducer = Transducer.from_file(path)
        self.pattern = regex.compile(pattern)
        size = max(self.transducer.bytes_of) + 1
        self.pieces = [self.transducer.bytes_of.get(i, b"") for i in range(size)]
        self.recent = _Recent(lambda word: self.transducer.encode(word.encode()))
        names = [b" %d" % i for i in range(size)]
        self.names = np.array(names, f"S{max(map(len, names))}")
        self.raw, self.sizes = np.frombuffer(b"".join(self.pieces), np.uint8), np.array(list(map(len, self.pieces)))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, at most RUN at a time where there are many."""
        if len(text) < 4 * RUN:
            yield [w for w in self.pattern.findall(text) if w]
            return
        words = (m[0] for m in self.pattern.finditer(text) if m[0])
        while run := list(islice(words, RUN)):
            yield run

    def encode(self, text: str) -> list[int]:
        return [i for run in self.runs(text) for i in self.recent.lookup(run)[0].tolist()]

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8Machine()
        return machine.feed(b"".join(map(self.pieces.__getitem__, ids))) + machine.finish()

    def _feed(self, held: list[tuple[_Digest, list[str]]]) -> None:
        ids, counts = self.recent.lookup([w for _, run in held for w in run])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(run) for _, run in held])]
        names = self.names[ids]
        sizes = self.sizes[ids]
        raw = self.raw[_ragged(self.starts[ids], sizes)].tobytes()
        raw_ends = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        low = raw_low = 0
        for (digest, _), high, raw_high in zip(held, ends.tolist(), raw_ends, strict=True):
            digest.feed(high - low, names[low:high].tobytes().translate(None, b"\0"), raw[raw_low:raw_high])
            low, raw_low = high, raw_high

    def digests(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, SHA-256 of the decimal ids, SHA-256 of the bytes that the ids decode to."""
        out, held, size = [], [], 0
        for text in texts:
            out.append(_Digest())
            for run in self.runs(text):
                held.append((out[-1], run))
                size += len(run)
                if size >= RUN:
                    self._feed(held)
                    held, size = [], 0
        if held:
            self._feed(held)
        return [d.result() for d in out]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each task of a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


@contextlib.contextmanager
def _task(path: str, pattern: str) -> Iterator[Codec]:
    """A codec until the end of a task; the worker may go on with other stages, and loading takes a tenth of a second."""
    before = gc.get_threshold()
    gc.set_threshold(100_000, 50, 50)  # states are many and live long; each full collection would visit all
    try:
        yield codec(path, pattern)
    finally:
        _codecs.clear()
        gc.set_threshold(*before)
        give_back()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the ids of each text as an array; null text gives an empty array."""

    @F.pandas_udf("array<int>")
    def ids_of(texts):  # noqa: ANN001, ANN202
        own = codec(path, pattern)
        return texts.map(lambda t: own.encode(t or ""))

    return docs.withColumn(ids, ids_of(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text that an array of ids stands for; null gives an empty text, unknown ids nothing."""

    @F.pandas_udf("string")
    def text_of(rows):  # noqa: ANN001, ANN202
        own = codec(path, pattern)
        size = len(own.pieces)
        return rows.map(lambda x: own.decode(i for i in (x if x is not None else ()) if 0 <= i < size))

    return docs.withColumn(text, text_of(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _task(path, pattern) as own:
            for batch in pieces(batches, "text"):
                n, written, decoded = zip(*own.digests(t or "" for t in batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
