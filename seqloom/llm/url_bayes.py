"""Operator 5: URL filters by allow and block rules, and by naive Bayes over segmented host names.

Rules come first: a rule fits its host and all subdomains if the path starts with its path; the
longest (host and path together) wins, on a tie the greater text. URLs that no rule fits are judged by
multinomial naive Bayes, trained on the URLs that rules fit. Its tokens are the path's alphanumeric
words and the host's words; a host label is split into words by the Viterbi path of a unigram model,
whose word counts come from all pages' text; a run of digits is a label of its own. The dictionary is not limited: labels' substrings meet it
in a join, and only a label's own substrings are gathered to segment it.

Nulls: a null URL, or one without ``://``, has empty host and path; no rule fits those, and they are
judged by the classes' priors. Where no URL is ruled out (or in), all are allowed (or blocked if all
ruled ones are). Equal URLs get equal verdicts; rows with a null page_id are answered as any other.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.scratch import materialise

#: The rules of the contract, as verdict, host and path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The longest word that a label is searched for, and the smoothing of token counts.
LONGEST, SMOOTHING = 24, 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, ruled (its verdict) for each of the distinct urls (host, path) that a rule fits."""
    labels = F.split("host", r"\.")
    at = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.transform(at, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("verdict").alias("ruled"), F.col("host").alias("suffix"), F.col("path").alias("start"))
    met = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(named, "suffix").where(F.col("path").startswith(F.col("start")))
    best = F.struct(F.length(F.concat("suffix", "start")).alias("n"), F.concat("suffix", "start").alias("rule"), "ruled")
    return met.groupBy("host", "path").agg(F.max(best).alias("m")).select("host", "path", "m.rule", "m.ruled")


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n for all words of two or more letters in a column of HTML or plain text."""
    plain = F.lower(F.regexp_replace(F.col("text"), r"<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """The best split of a label; found: start, end and count of its dictionary words. Other words cost more by length."""
    cost, back = [0.0] + [math.inf] * len(label), [0] * (len(label) + 1)
    by_start: dict[int, list[tuple[int, float]]] = {}
    for low, high, n in found:
        by_start.setdefault(low, []).append((high, -math.log(n / total)))
    unit = math.log(max(total, 2)) + math.log(10)
    for low in range(len(label)):
        for high, c in by_start.get(low, ()):
            if cost[low] + c < cost[high]:
                cost[high], back[high] = cost[low] + c, low
        for high in range(low + 1, min(low + LONGEST, len(label)) + 1):
            c = cost[low] + unit + (high - low - 1) * math.log(10)
            if c < cost[high]:
                cost[high], back[high] = c, low
    out, at = [], len(label)
    while at:
        out.append(label[back[at] : at])
        at = back[at]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for each of the distinct labels, by the unigram model of counts (word, n)."""
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    lows = labels.where(F.length("label") > 0).select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("low"))
    lows = lows.where(F.col("low") < F.length("label"))
    ends = F.sequence(F.col("low") + 1, F.least(F.col("low") + F.lit(LONGEST - 1), F.length("label")))
    parts = lows.select("label", "low", F.explode(ends).alias("high"))
    parts = parts.select("label", "low", "high", F.expr("substring(label, low, high - low + 1)").alias("word"))
    met = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct((F.col("low") - 1).alias("a"), F.col("high").alias("b"), "n")).alias("found"))
    rows = labels.join(met, "label", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            split = [viterbi(x, [(f["a"], f["b"], f["n"]) for f in found or ()], max(total, 1)) for x, found in zip(names, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], ["label", "words"])

    return rows.select("label", "found").mapInArrow(run, "label string, words array<string>")


def tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """host, path, token (a row for each occurrence) of the distinct urls; host words are marked by a leading dot."""
    hosts = materialise(urls.select("host").distinct().select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"\p{L}+|\p{N}+"), F.lit(0))).alias("at", "label")), "labels")
    split = segment(hosts.select("label").distinct(), counts)
    of_host = hosts.join(split, "label").select("host", F.explode("words").alias("word"))
    of_host = urls.join(of_host, "host").select("host", "path", F.concat(F.lit("."), "word").alias("token"))
    of_path = urls.select("host", "path", F.explode(F.split(F.lower("path"), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")
    return of_host.unionByName(of_path)


def classify(urls: DataFrame, ruled: DataFrame, found: DataFrame) -> DataFrame:
    """host, path, odds: the log odds of block against allow for each of the distinct urls (with n, their rows).

    ruled: host, path, ruled as of match_rules(); found: as of tokens(). Each row of a ruled URL counts.
    """
    blocked = (F.col("ruled") == "block").cast("long") * F.col("n")
    taught = urls.join(ruled.select("host", "path", "ruled"), ["host", "path"])
    prior = taught.agg(F.coalesce(F.sum(blocked), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_block, n_allow = int(prior[0]), int(prior[1]) - int(prior[0])
    if not n_block or not n_allow:
        return urls.select("host", "path", F.lit(1.0 if n_block else -1.0).alias("odds"))
    table = found.join(taught, ["host", "path"]).groupBy("token").agg(F.sum(blocked).alias("b"), F.sum(F.col("n") - blocked).alias("a"))
    table = materialise(table, "tokens")
    sums = table.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")).first()
    b, a, v = (int(x) for x in sums)
    odds = F.log((F.col("b") + SMOOTHING) / (b + SMOOTHING * (v + 1))) - F.log((F.col("a") + SMOOTHING) / (a + SMOOTHING * (v + 1)))
    scored = found.join(table.select("token", odds.alias("odds")), "token").groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    base = math.log(n_block / n_allow)
    return urls.select("host", "path").join(scored, ["host", "path"], "left").select("host", "path", (F.lit(base) + F.coalesce("odds", F.lit(0.0))).alias("odds"))


def judge(pages: DataFrame, rules: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, odds for each row of pages (page_id, url).

    rules: verdict, host, path; texts: a column ``text`` that the dictionary is counted from.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    ruled = materialise(match_rules(urls, rules), "ruled")
    counts = materialise(word_counts(texts), "words")
    found = materialise(tokens(urls, counts), "found")
    odds = classify(urls, ruled, found)
    known = odds.join(ruled, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    known = known.select("host", "path", "rule", verdict.alias("verdict"), "odds")
    return rows.join(known, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "odds")
