"""Operator 8: quality rules by robust multivariate outliers (minimum covariance determinant).

Each text gives a vector of transformed statistics. For each language and source (and, for groups with
too few texts, each language, and all texts) concentration steps find the half of the texts whose
covariance has the least determinant: centre and covariance of the current half, squared Mahalanobis
distances of all texts, and the nearest COVERAGE of them as the next one. Steps go on from each of
three starts (medians and quartiles; the shortest halves of each statistic; softly cut statistics) until
the determinant falls no more, and the start with the least one counts. So a group may have nearly half
bad texts. Then all texts within the GOOD quantile of the half's distances give the final centre and covariance; the scale is
from the median distance of all texts. Parts are found by a quantile of the distances (texts at the very
quantile belong to the part) and described by sums, so that a step is two aggregations with partial sums.
Texts meet their group's estimate by a broadcast where there are at most SMALL estimates, else in a join
dealt by group and SALTS parts of its texts; so no group is ever gathered in a task. All texts take part;
there is no sampling.

Nulls: a null text has no words (and fails the base rule); null language and source form groups of
their own. Texts that fail the base rule take no part in the estimates. Repeated rows count each. Texts of
any length are described whole, and count as one each. A text at the very bound is kept.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.scratch import materialise, release
from seqloom.llm.text import NON_SPACE, Words, column_bytes, mix, pieces, windows

#: Part of the texts that the steps rest on, texts that a group must have.
COVERAGE, LEAST_GROUP = 0.5, 100
#: Rows of a table of groups up to which it is broadcast, and parts of a group's texts beyond that.
SMALL, SALTS = 20_000, 64
#: Fall of the determinant's logarithm below which steps end, quantile up to which texts count as good.
SETTLED, GOOD = 1e-3, 0.975
#: Chance that a text of a normal group lies beyond the bound, and the factor for heavier tails than normal.
TAIL, HEAVY = 1e-6, 6.0
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: The statistics, and the least standard deviation that each counts as having.
FEATURES = {"words": 0.5, "word_length": 0.1, "length_spread": 0.2, "symbols": 0.3, "dup_lines": 0.8, "repeats": 1.0, "digits": 0.6, "capitals": 0.4}

MODEL = "group string, start int, center array<double>, inverse array<double>, logdet double"
_ARROW_MODEL = pa.schema([("group", pa.string()), ("start", pa.int32()), ("center", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("logdet", pa.float64())])
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True for each key that equals an earlier one."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def _in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))


def describe(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rule and the statistics, for each text of a column."""
    data, bounds = column_bytes(column)
    words = Words(data, bounds, NON_SPACE)
    n = words.counts
    characters = (data & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(characters & NON_SPACE[data], dtype=np.int64)])
    word_chars = np.diff(upto[bounds])
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    n_symbols = _sums(table[data], bounds)

    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([bounds[:-1], breaks + 1])), np.sort(np.concatenate([breaks, bounds[1:]]))
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    text = np.searchsorted(bounds, starts, "right") - 1
    later = _later(_in_text(words.spans_hash(starts, ends), text))
    n_dup = np.bincount(text[later], minlength=len(n))
    n_lines = np.bincount(text, minlength=len(n))

    begins, hashes = windows(words.hashes(), words.offsets, 3)
    again = begins[_repeated(_in_text(hashes, words.text_index[begins]))]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    n_repeat = _sums(covered, words.offsets)

    lengths = (upto[words.ends] - upto[words.starts]).astype(float)
    total = np.concatenate([[0.0], np.cumsum(lengths)])
    squares = np.concatenate([[0.0], np.cumsum(lengths**2)])
    some = np.maximum(n, 1)
    mean = np.diff(total[words.offsets]) / some
    spread = np.sqrt(np.maximum(np.diff(squares[words.offsets]) / some - mean**2, 0))
    digits = _sums((data >= 48) & (data <= 57), bounds)
    capitals = _sums((data >= 65) & (data <= 90), bounds)
    share = lambda a, b: np.log((a + 0.5) / (b + 25.0) + 0.01)
    statistics = np.stack(
        [np.log1p(n), np.log(mean + 0.5), np.log(spread + 0.5), share(n_symbols, word_chars), share(n_dup, n_lines), share(n_repeat, n), share(digits, word_chars), share(capitals, word_chars)],
        axis=1,
    )
    return {"n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "x": statistics}


def counts(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns, the five counts, base_failed and the statistics ``x`` of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = describe(batch.column(len(keys)))
            x = found.pop("x")
            heads = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], *(pa.array(v.astype(np.int64)) for v in found.values()), pa.ListArray.from_arrays(heads, pa.array(x.ravel()))],
                [*keys, *found, "x"],
            )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    out = docs.select(*keys, "text").mapInArrow(run, f"{kinds}, {COUNTS}, x array<double>")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _chi_square(p: int, chance: float) -> float:
    """The quantile of a chi-squared variable with p degrees of freedom (Wilson and Hilferty's cube)."""
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < chance else (low, mid)
    return p * (1 - 2 / (9 * p) + low * math.sqrt(2 / (9 * p))) ** 3


def _levels() -> Column:
    """The groups of a text, from the finest to all texts."""
    lang, source = F.coalesce(F.to_json(F.struct("lang")), F.lit("{}")), F.coalesce(F.to_json(F.struct("lang", "source")), F.lit("{}"))
    return F.array(F.concat(F.lit("source "), source), F.concat(F.lit("lang "), lang), F.lit("all"))


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of ``x`` from ``center`` by the flat inverse ``inverse``."""
    y = [F.col("x")[i] - F.col("center")[i] for i in range(p)]
    return sum((y[i] * y[i] * F.col("inverse")[i * p + i] + sum((2 * y[i] * y[j] * F.col("inverse")[i * p + j] for j in range(i)), F.lit(0.0)) for i in range(p)), F.lit(0.0))


def _estimate(part: DataFrame, p: int) -> DataFrame:
    """group, start, center, inverse, logdet from the sums over the part of each group and start."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(p)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)]
    found = part.groupBy("group", "start").agg(F.count("*").alias("n"), *sums, *products)
    floor = np.diag(np.square(list(FEATURES.values())))
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(float)
            centers, inverses, logs = [], [], []
            for row in table:
                center = row[1 : 1 + p] / row[0]
                cov = np.zeros((p, p))
                for (i, j), q in zip(pairs, row[1 + p :], strict=True):
                    cov[i, j] = cov[j, i] = q / row[0] - center[i] * center[j]
                centers.append(center.tolist())
                inverses.append(np.linalg.inv(cov + floor).ravel().tolist())
                logs.append(np.linalg.slogdet(cov + floor)[1])
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(centers, doubles), pa.array(inverses, doubles), pa.array(logs, pa.float64())], ["group", "start", "center", "inverse", "logdet"]
            )

    return found.mapInArrow(run, MODEL)


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (with x) joined with a written table that has a few rows for each group."""
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def _used(good: DataFrame, least: int) -> DataFrame:
    """The groups that are the finest one with enough texts for some text."""
    levels = good.select(_levels().alias("l")).groupBy("l").agg(F.count("*").alias("n"))
    lang = levels.groupBy(F.col("l")[1].alias("lang")).agg(F.sum("n").alias("m"))
    level = F.when(F.col("n") >= least, 0).when(F.col("m") >= least, 1).otherwise(2)
    return levels.join(lang, F.col("l")[1] == F.col("lang")).select(F.get("l", level).alias("group")).distinct()


def _starts(rows: DataFrame, p: int) -> DataFrame:
    """The three starts of each group, as of _estimate()."""
    grid = F.array(*(F.lit(k / 20) for k in range(21)))
    found = rows.groupBy("group").agg(*(F.percentile_approx(F.col("x")[i], grid, 1000).alias(f"f{i}") for i in range(p)))
    floors = np.array(list(FEATURES.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                q = np.array([row[f"f{i}"] for i in range(p)])
                width = q[:, 10:] - q[:, :11]
                at = width.argmin(1)
                low = np.take_along_axis(q, at[:, None], 1)[:, 0]
                short = width.min(1)
                for k, (center, spread) in enumerate(((q[:, 10], q[:, 15] - q[:, 5]), (low + short / 2, short))):
                    inverse = np.diag(np.maximum(spread / 1.349, floors) ** -2.0)
                    out.append((row["group"], k, center.tolist(), inverse.ravel().tolist(), math.inf))
            yield pa.RecordBatch.from_pylist([dict(zip(("group", "start", "center", "inverse", "logdet"), r, strict=True)) for r in out], schema=_ARROW_MODEL)

    first = materialise(found.mapInArrow(run, MODEL), "mcd")
    z = [(F.col("x")[i] - F.col("center")[i], F.sqrt(F.col("inverse")[i * p + i])) for i in range(p)]
    cut = F.array(*(F.col("center")[i] + F.tanh(d * s) / s for i, (d, s) in enumerate(z)))
    soft = _meet(rows, first.where("start = 0"), ["group"]).select("group", F.lit(2).alias("start"), cut.alias("x"))
    both = materialise(first.unionByName(_estimate(soft, p).withColumn("logdet", F.lit(math.inf))), "mcd")
    release(first)
    return both


def _step(rows: DataFrame, model: DataFrame, p: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """Estimates from the nearest texts of each group and start, and the table of distances to be released."""
    near = _meet(rows, model, ["group"]).select("group", "start", "x", _distance(p).alias("d2"))
    cut = materialise(near.groupBy("group", "start").agg(F.percentile_approx("d2", coverage, 1000).alias("cut")), "cut")
    return _estimate(_meet(near, cut, ["group", "start"]).where("d2 <= cut").select("group", "start", "x"), p), cut


def _least_determinant(rows: DataFrame, p: int, coverage: float) -> DataFrame:
    """The estimate with the least determinant of each group, over all starts, each taken until it settles."""
    active, settled = _starts(rows, p), []
    while True:
        new, cut = _step(rows, active, p, coverage)
        # a start that settles keeps the smaller determinant of its last two
        old = active.select("group", "start", *(F.col(c).alias(f"old_{c}") for c in ("center", "inverse", "logdet")))
        met = new.join(old, ["group", "start"])
        worse = F.col("old_logdet") < F.col("logdet")
        best = [F.when(worse, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in ("center", "inverse", "logdet")]
        both = materialise(met.select("group", "start", *best, (F.col("old_logdet") - F.col("logdet") > SETTLED).alias("falls")), "mcd")
        release(active, cut)
        settled.append(both.where("not falls").drop("falls"))
        active = both.where("falls").drop("falls")
        if active.isEmpty():
            break
    every = functools.reduce(DataFrame.unionByName, settled)
    best = F.min_by(F.struct("start", "center", "inverse", "logdet"), F.struct("logdet", "start"))
    return materialise(every.groupBy("group").agg(best.alias("b")).select("group", "b.*"), "mcd")


def fit(described: DataFrame, coverage: float = COVERAGE, least: int = LEAST_GROUP) -> DataFrame:
    """group, center, inverse, scale and bound for each group that is the finest with enough texts (or all texts) for some text.

    described: lang, source, x and base_failed, as of counts(). Distances are divided by ``scale`` so
    that their median is that of a chi-squared variable; a text is an outlier beyond ``bound``.
    """
    p = len(FEATURES)
    good = described.where(~F.col("base_failed"))
    used = materialise(_used(good, least), "groups")
    rows = materialise(_meet(good.select(F.explode(_levels()).alias("group"), "x"), used, ["group"], "left_semi"), "rows")
    raw = _least_determinant(rows, p, coverage)

    def scaled(model: DataFrame) -> DataFrame:
        median = _meet(rows, model, ["group"]).select("group", _distance(p).alias("d2")).groupBy("group").agg(F.percentile_approx("d2", 0.5, 1000).alias("median"))
        return materialise(model.join(median, "group").withColumn("scale", F.greatest(F.col("median") / _chi_square(p, 0.5), F.lit(1e-9))).drop("median"), "mcd")

    first = scaled(raw)
    inside = _meet(rows, first, ["group"]).where(_distance(p) <= F.col("scale") * _chi_square(p, GOOD)).select("group", "start", "x")
    model = materialise(_estimate(inside, p), "mcd")
    out = scaled(model)
    release(raw, first, model, used, rows)
    return out.select("group", "center", "inverse", "scale", F.lit(HEAVY * _chi_square(p, 1 - TAIL)).alias("bound"))


def judge(described: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``distance`` (scaled; null if base_failed) and ``kept`` to each row, by its finest group with a model."""
    known = [F.col("l")[i] for i in range(3)]
    names = model.select("group")
    marked = described.withColumn("l", _levels())
    for i in range(2):
        marked = _meet(marked.withColumn(f"k{i}", known[i]), names.select(F.col("group").alias(f"k{i}"), F.col("group").alias(f"g{i}")), [f"k{i}"], "left")
    marked = marked.withColumn("group", F.coalesce("g0", "g1", known[2])).drop("g0", "g1", "k0", "k1", "l")
    out = _meet(marked, model, ["group"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance(len(FEATURES)) / F.col("scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("bound"), F.lit(True))
    return out.withColumn("kept", kept).drop("group", "center", "inverse", "scale", "bound")


def outliers(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance, kept for each row of docs (doc_id, text, lang, source)."""
    described = materialise(counts(docs, "doc_id", "lang", "source"), "statistics")
    model = materialise(fit(described), "mcd")
    out = judge(described, model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
