"""Operator 6: secrets by fixed patterns and by a battery of randomness tests.

A candidate is a run of 20 or more characters of the common encodings. Its encoding (and with that the
size k of its alphabet) is inferred from its characters. Under uniform draws from k symbols three
statistics are standard normal: the chi-squared statistic of symbol counts (by Wilson and Hilferty's
cube root), the number of runs above and below the middle symbol, and the lag-one serial correlation.
The sum of their squares is small for random strings and large for words.

The null distribution of that sum is a fixed one that no corpus changes: REFERENCE strings for each k,
of letters drawn one by one with English frequencies (in base 64 as words with capitals, separators and
numbers; for smaller alphabets modulo k), all of the least length of a band. That is the safe side, as
the tests grow stronger with length, and as real words repeat more than single letters do. A string's
p-value is its place among these; false discovery is controlled on them for each encoding and length
band on its own (Benjamini and Hochberg). Strings of letters that are lower-case after the first are an
encoding too, with k = 26.

Only DataFrame functions touch the texts. The counts by encoding, band and score, which are at most a
few ten thousand rows of numbers however large the corpus is, come to the driver.

Texts are searched whole, in time that follows their length. Nulls: a null text is empty and has no span. Positions are code points, ends exclusive. Repeated rows
are answered each. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, and the least length of what they must find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
#: Kinds in the order in which they are listed at one start.
KINDS = ("assign", "access", "hex", "random")
#: What may be an encoded secret, and which of those are of the 26 letters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"^[A-Za-z][a-z]+$"
#: Alphabet sizes, tested in order; 64 takes what is left.
DECIMAL, HEXADECIMAL, LETTERS, BASE32, BASE64 = 10, 16, 26, 32, 64
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
#: Where length bands begin, how finely scores are counted, the largest one counted, the false-discovery rate.
BANDS, FINE, TOP, RATE = (20, 24, 32, 48, 96), 4, 400, 0.05

#: Strings of the reference for each alphabet and band, and the frequencies of a to z in them, in ten thousands.
REFERENCE = 20_000
ENGLISH = (817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7)

_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """The matches of a pattern as an array of (start, kind, end, text); text is of the given group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), part.alias("g"))
    # the starts go to one string: an array would be copied element by element at each match
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("starts"))

    def step(acc: Column, row: Column) -> Column:
        low = acc["at"] + F.length(row["b"])
        return F.struct((low + F.length(row["m"])).alias("at"), F.concat(acc["starts"], low.cast("string"), F.lit(",")).alias("starts"))

    def span(row: Column) -> Column:
        low = row["s"].cast("int")
        return F.struct(low.alias("start"), F.lit(kind).alias("kind"), (low + F.length(row["r"]["m"])).alias("end"), row["r"]["g"].alias("text"))

    def placed(r: Column) -> Column:
        starts = F.split(F.aggregate(r, zero, step, lambda acc: acc["starts"]), ",")
        return F.transform(F.arrays_zip(r.alias("r"), F.slice(starts, 1, F.size(r)).alias("s")), span)

    # rows are bound once, so that the text is not searched again for each use
    return F.transform(F.array(rows), placed)[0]


def _alphabet(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), DECIMAL)
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), HEXADECIMAL)
        .when(token.rlike(WORD), LETTERS)
        .when(token.rlike("^[A-Z2-7]+=*$"), BASE32)
        .otherwise(BASE64)
    )


def _band(token: Column) -> Column:
    return sum((F.length(token) >= low).cast("int") for low in BANDS) - 1


def score(token: Column, k: Column) -> Column:
    """The sum of squares of the three statistics, under uniform draws from k symbols."""
    # k is bound once, so that lambdas do not infer it from the whole token at each symbol
    return F.transform(F.array(k), lambda one: _score(token, one))[0]


def _score(token: Column, k: Column) -> Column:
    plain = F.translate(token, "-_", "+/")
    plain = F.when((k == HEXADECIMAL) | (k == LETTERS), F.lower(plain)).otherwise(F.regexp_replace(plain, "=+", ""))
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    v = F.transform(letters, lambda c: F.pmod(F.instr(F.lit(SYMBOLS), c) - 1, k))
    k = k.cast("double")
    n = F.size(v).cast("double")
    mid = (k - 1) / 2

    def tie(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.cast("int").alias("last"), run.cast("int").alias("run"), (acc["sum"] + 2 * run - 1).cast("double").alias("sum"))

    squares = F.aggregate(F.array_sort(v), F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")), tie, lambda acc: acc["sum"])
    chi = k / n * squares - n
    free = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))

    def walk(acc: Column, x: Column) -> Column:
        first = acc["last"] < 0
        turn = ~first & ((acc["last"] > mid) != (x > mid))
        product = F.when(first, 0.0).otherwise((acc["last"] - mid) * (x - mid))
        return F.struct(x.cast("int").alias("last"), (acc["runs"] + F.when(turn, 1.0).otherwise(0.0)).alias("runs"), (acc["serial"] + product).alias("serial"))

    path = F.aggregate(v, F.struct(F.lit(-1).alias("last"), F.lit(1.0).alias("runs"), F.lit(0.0).alias("serial")), walk)
    z_runs = (path["runs"] - (n + 1) / 2) / F.sqrt((n - 1) / 4)
    z_serial = path["serial"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
    return F.when(n >= 2, z_chi * z_chi + z_runs * z_runs + z_serial * z_serial).otherwise(F.lit(float(TOP)))


def _fine(value: Column) -> Column:
    return F.least(F.floor(value * FINE), F.lit(TOP * FINE)).cast("int")


def _scores(v: np.ndarray, k: int) -> np.ndarray:
    """score() of each row of symbol numbers."""
    m, n = v.shape
    mid, free = (k - 1) / 2, k - 1
    counts = np.bincount((v + k * np.arange(m)[:, None]).ravel(), minlength=m * k).reshape(m, k)
    chi = np.maximum(k / n * np.square(counts).sum(1) - n, 0)
    z_chi = (np.cbrt(chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))
    high = v > mid
    z_runs = (1 + (high[:, 1:] != high[:, :-1]).sum(1) - (n + 1) / 2) / np.sqrt((n - 1) / 4)
    z_serial = ((v[:, 1:] - mid) * (v[:, :-1] - mid)).sum(1) / ((k * k - 1) / 12) / np.sqrt(n - 1)
    return z_chi**2 + z_runs**2 + z_serial**2


@functools.cache
def reference(k: int, band: int) -> np.ndarray:
    """The sorted scores (in steps of 1 / FINE) of the reference strings."""
    rng = np.random.default_rng(1000 * k + band)
    shape = (REFERENCE, BANDS[band])
    letters = rng.choice(26, shape, p=np.array(ENGLISH) / sum(ENGLISH))
    v = letters + (36 if k == BASE32 else 10)
    if k == BASE64:
        # words begin at one place in six, by a capital, a separator or a digit in equal parts; a third of the strings have none
        begins = (rng.random(shape) < 1 / 6) & (rng.random(REFERENCE) < 2 / 3)[:, None]
        kind = rng.integers(0, 3, shape)
        start = np.where(kind == 0, letters + 36, np.where(kind == 1, rng.integers(62, 64, shape), rng.integers(0, 10, shape)))
        v = np.where(begins, start, v)
    return np.sort(np.minimum(np.floor(_scores(v % k, k) * FINE), TOP * FINE).astype(int))


def bounds(docs: DataFrame, rate: float = RATE) -> dict[tuple[int, int], int]:
    """The largest score (in steps of 1 / FINE) that counts as random, by alphabet size and length band."""
    tokens = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(CANDIDATE), F.lit(0))).alias("token"))
    k = _alphabet(F.col("token"))
    scored = tokens.select(k.alias("k"), _band(F.col("token")).alias("band"), _fine(score(F.col("token"), k)).alias("step"))
    counted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in scored.groupBy("k", "band", "step").agg(F.count("*").alias("n")).collect():
        counted.setdefault((r["k"], r["band"]), []).append((r["step"], r["n"]))
    out = {}
    for key, found in counted.items():
        steps, n = np.array(sorted(found)).T
        chance = (1 + np.searchsorted(reference(*key), steps, "right")) / (1 + REFERENCE)
        ok = chance * n.sum() <= rate * np.cumsum(n)
        if ok.any():
            out[key] = int(steps[ok].max())
    return out


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Each row of docs (doc_id, text) with ``found``: its spans (start, kind, end, text) by start and kind."""
    known = bounds(docs, rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPAN)
    assign = F.when(text.rlike(ASSIGN), F.filter(_spans(text, ASSIGN, 0, group=2), lambda s: F.length(s["text"]) >= ASSIGN_LENGTH)).otherwise(none)
    access = F.when(text.contains("AKIA"), F.filter(_spans(text, ACCESS, 1), lambda s: F.length(s["text"]) >= ACCESS_LENGTH)).otherwise(none)
    digits = F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none)
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.array_sort(F.concat(assign, access, digits)).alias("base"))
    if not known:
        return rows.withColumn("found", F.col("base"))
    most = F.create_map(*(F.lit(x) for (k, band), step in sorted(known.items()) for x in (k * 100 + band, step)))

    def random(s: Column) -> Column:
        k = _alphabet(s["text"])
        return F.coalesce(_fine(score(s["text"], k)) <= most[k * 100 + _band(s["text"])], F.lit(False))

    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    strings = _spans(F.col("text"), CANDIDATE, 3)
    more = F.when(F.col("text").rlike(CANDIDATE), F.filter(F.filter(strings, clear), random)).otherwise(none)
    return rows.withColumn("found", F.array_sort(F.concat("base", more)))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""
    found = find(docs, rate)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans")
    )
