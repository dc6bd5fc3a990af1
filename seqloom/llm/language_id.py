"""Operator 10: language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three code points, within a word and its two ends) hashed to
2**16 buckets; a text's value of a bucket is its relative frequency times the bucket's inverse
document frequency, counted over all labelled training texts. The weights are learned by
follow-the-regularised-leader with elastic-net penalties, from a sample of labelled rows that is
bounded by SAMPLE (dealt evenly over the languages, chosen by a hash of the id). A part of that sample
is set aside for the temperature that calibrates the probabilities.

A text that is null or has no letter gets ``und`` and score 0; so does every text if nothing can be
learned. A null id is never learned from and counts as held out. With one learned language, all texts
get it. Texts are read whole. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.text import LOWER, NON_SPACE, Words, column_bytes, pieces

#: Rows that the classifier is fitted on at most (on average, as they are chosen by hash); a fifth of them calibrates.
SAMPLE = 6000
ORDERS, BUCKETS = (1, 2, 3), 1 << 16
EPOCHS, BATCH, ALPHA, BETA, L1, L2 = 6, 32, 0.5, 1.0, 1e-4, 1e-5
#: Relative frequencies are small; this brings a text's values near one.
GAIN = 20.0
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


class Grams:
    """The words of some texts as types, and each type's buckets."""

    def __init__(self, column: pa.Array) -> None:
        data, bounds = column_bytes(column)
        words = Words(LOWER[data], bounds, NON_SPACE)
        self.offsets = words.offsets
        _, at, self.types = np.unique(words.hashes(), return_index=True, return_inverse=True)
        joined = b" ".join([b"", *[words.word(i) for i in at], b""]).decode("utf-8", "replace").lower()
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        space = points == 32
        bounds = np.flatnonzero(space)  # word k lies between bounds k and k + 1
        letters = np.concatenate([[0], np.cumsum(_is_letter()[points])])
        self.has_letter = np.diff(letters[bounds]) > 0 if len(at) else np.zeros(0, bool)
        found, owner = [], []
        word = np.cumsum(space) - 1
        for n in ORDERS:
            m = len(points) - n + 1
            if m <= 0 or not len(at):
                continue
            code = np.full(m, n, np.uint64)
            inner = np.zeros(m, bool)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + points[k : m + k].astype(np.uint64)
                if 0 < k < n - 1:
                    inner |= space[k : m + k]
            if n == 1:
                inner |= space[:m]
            keep = np.flatnonzero(~inner & (word[:m] < len(at)))
            own = code[keep]
            own ^= own >> np.uint64(31)
            own *= np.uint64(0x9E3779B97F4A7C15)
            found.append((own >> np.uint64(48)).astype(np.int32))
            owner.append(np.where(space[keep] | (n == 1), word[keep], word[keep]))
        buckets = np.concatenate(found) if found else np.zeros(0, np.int32)
        owners = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        self.buckets = buckets[order]
        self.heads = np.searchsorted(owners[order], np.arange(len(at) + 1))
        self.sizes = np.diff(self.heads)

    def by_text(self, per_type: np.ndarray) -> np.ndarray:
        """Sums over each text's words of a value (or row of values) per type."""
        total = np.zeros((len(self.types) + 1, *per_type.shape[1:]))
        np.cumsum(per_type[self.types], axis=0, out=total[1:])
        return np.diff(total[self.offsets], axis=0)

    def expand(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the given types, one after another, and how many each has."""
        sizes = self.sizes[types]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.heads[types] - ends + sizes, sizes)
        return self.buckets[at], sizes


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket by language, with the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, grams: Grams) -> np.ndarray:
        scores = np.zeros((len(grams.sizes), len(self.languages)))
        if len(grams.buckets):
            scores = np.add.reduceat(self.weights[grams.buckets], grams.heads[:-1], axis=0)
        total = np.maximum(grams.by_text(grams.sizes.astype(float)), 1)
        return grams.by_text(scores) * (GAIN / total)[:, None] + self.bias


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in pieces(batches, "text"):
            grams = Grams(batch.column(0))
            for low in range(0, batch.num_rows, 128):
                offsets = grams.offsets[low : min(low + 128, batch.num_rows) + 1]
                types = grams.types[offsets[0] : offsets[-1]]
                n = len(offsets) - 1
                text = np.repeat(np.arange(n), np.diff(offsets))
                pair = np.unique(text * len(grams.sizes) + types)
                buckets, sizes = grams.expand(pair % max(len(grams.sizes), 1))
                seen = np.zeros((n, BUCKETS), bool)
                seen[np.repeat(pair // max(len(grams.sizes), 1), sizes), buckets] = True
                total[:BUCKETS] += seen.sum(axis=0)
            texts += batch.num_rows
        total[BUCKETS] = texts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def _sample(docs: DataFrame, size: int) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Languages, and (language, buckets, relative frequencies) of the sampled texts."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    quota = size / max(len(languages), 1)
    chance = F.create_map(*(F.lit(x) for k in languages for x in (k, float(min(1.0, quota / counts[k]))))) if languages else None
    if chance is None:
        return [], []
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < chance[F.col("lang")] * F.lit(float(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            grams = Grams(batch.column(1))
            for i in range(batch.num_rows):
                buckets, _ = grams.expand(grams.types[grams.offsets[i] : grams.offsets[i + 1]])
                at, n = np.unique(buckets, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([(n / max(n.sum(), 1)).astype(np.float32)], pa.list_(pa.float32()))],
                    ["lang", "order", "buckets", "values"],
                )

    order = F.xxhash64(F.lit("order"), F.col("doc_id").cast("string"))
    rows = drawn.select("lang", "text", order.alias("order")).mapInArrow(run, "lang string, order long, buckets array<int>, values array<float>").toArrow()
    by_order = np.argsort(rows.column("order").to_numpy(), kind="stable")
    number = {k: i for i, k in enumerate(languages)}
    langs, buckets, values = rows.column("lang").to_pylist(), rows.column("buckets").combine_chunks(), rows.column("values").combine_chunks()
    return languages, [(number[langs[i]], buckets[int(i)].values.to_numpy(), values[int(i)].values.to_numpy()) for i in by_order]


def _learn(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader over batches; the last place is the bias."""
    z, n, w = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[low : low + BATCH]]
            at = np.concatenate([np.append(b, BUCKETS) for _, b, _ in part])
            x = np.concatenate([np.append(v * idf[b] * GAIN, 1.0) for _, b, v in part])
            heads = np.concatenate([[0], np.cumsum([len(b) + 1 for _, b, _ in part])])
            p = _softmax(np.add.reduceat(w[at] * x[:, None], heads[:-1], axis=0))
            p[np.arange(len(part)), [k for k, _, _ in part]] -= 1
            where, slot = np.unique(at, return_inverse=True)
            row = np.repeat(np.arange(len(part)), np.diff(heads))
            g = np.stack([np.bincount(slot, x * p[row, c], minlength=len(where)) for c in range(classes)], axis=1) / len(part)
            sigma = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / ALPHA
            z[where] += g - sigma * w[where]
            n[where] += g * g
            l1 = np.where(where == BUCKETS, 0.0, L1)[:, None]
            step = -(z[where] - np.sign(z[where]) * l1) / ((BETA + np.sqrt(n[where])) / ALPHA + L2)
            w[where] = np.where(np.abs(z[where]) <= l1, 0.0, step)
    return w[:BUCKETS], w[BUCKETS]


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden sections of its logarithm."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        top = scaled.max(axis=1)
        return float(np.mean(top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(truth)), truth]))

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, size: int = SAMPLE) -> Model | None:
    """Learn from all rows of docs (doc_id, text, lang) with text and lang; None if there is no such row."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    languages, rows = _sample(known, size)
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    counts, texts = document_frequencies(known)
    idf = np.log((1.0 + texts) / (1.0 + counts)) + 1.0
    aside = rows[::5] if len(rows) >= 50 else []
    weights, bias = _learn([r for i, r in enumerate(rows) if i % 5] if aside else rows, len(languages), idf)
    weights = weights * idf[:, None]
    logits = np.array([(weights[b] * v[:, None]).sum(axis=0) * GAIN + bias for _, b, v in aside])
    return Model(languages, weights.astype(np.float32), bias, _temperature(logits, np.array([k for k, _, _ in aside], int)) if aside else 1.0)


def predict(docs: DataFrame, model: Model | None, *keys: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The key columns (text may be one of them), and the predicted language and its probability, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS by languages, about 1 MB
    columns = list(keys) if "text" in keys else [*keys, "text"]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches, "text"):
            languages, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if own is not None:
                grams = Grams(batch.column(at))
                some = grams.by_text(grams.has_letter.astype(float)) > 0
                p = _softmax(own.logits(grams) / own.temperature)
                best = p.argmax(axis=1)
                languages = [own.languages[k] if s else UNKNOWN for k, s in zip(best, some, strict=True)]
                scores = np.where(some, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*keys, *names])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*columns).mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    """Whether a row is kept from learning: every fifth by CRC-32 of its id; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
