"""Each operator against brute force on the table of cases, and on an empty table."""

import collections
import functools
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqloom.llm import (
    bpe_transducer,
    compaction,
    language_id,
    line_spread,
    parity_join,
    positional_index,
    randomness,
    robust_outliers,
    suffix_tree,
    url_bayes,
)
from seqloom.llm.scratch import materialise, new_path
from tests.llm.cases import SCHEMA, documents, empty, frame

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_id(df, rows=None):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows or documents())
    return out


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def tree_scores(docs, held, depth):
    """Scores by the suffix tree's definition, with one dictionary for each length."""
    padded = [[1] * depth + SPACE.findall(low(d[1])) + [None] for d in docs]
    counts = [collections.Counter() for _ in range(depth + 1)]  # grams of k + 1 tokens
    context = [collections.Counter() for _ in range(depth + 1)]
    for q, h in zip(padded, held, strict=True):
        for i in range(depth, len(q)):
            for k in range(depth + 1):
                counts[k][tuple(q[i - k : i + 1])] += not h
                context[k][tuple(q[i - k : i])] += not h
    c, n, v = counts[0], context[0][()], sum(x > 0 for x in counts[0].values())
    states = [{} for _ in range(depth + 1)]
    for k in range(1, depth + 1):
        kinds, gain = collections.Counter(), collections.Counter()
        for g, x in counts[k].items():
            if x:
                kinds[g[:-1]] += 1
                gain[g[:-1]] += round(1024 * x * math.log(x / context[k][g[:-1]] / (counts[k - 1][g[1:]] / context[k - 1][g[1:-1]])))
        states[k] = {s: kinds[s] for s in kinds if context[k][s] >= 2 and gain[s] >= 2048 * kinds[s]}
    for q, h in zip(padded, held, strict=True):
        base = score = known = 0
        for i in range(depth, len(q)):
            p = (c[(q[i],)] + 1) / (n + v + 1)
            base += math.log10(p)
            known += c[(q[i],)] > 0
            for k in range(1, depth + 1):
                s = tuple(q[i - k : i])
                if w := states[k].get(s):
                    p = (counts[k][*s, q[i]] + w * p) / (context[k][s] + w)
            score += math.log10(p)
        yield h, len(q) - depth, known, n, base, score


@pytest.mark.parametrize(("depth", "size"), [(2, 1 << 19), (4, 1 << 19), (4, 300)])
def test_op1(spark, depth, size):
    docs = documents() + [(200 + i, *documents()[i][1:]) for i in range(0, 40, 3)]
    held = [d[0] is None or zlib.crc32(str(d[0]).encode()) % 7 == 2 for d in docs]
    rows = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = by_id(suffix_tree.scores(rows, depth, size), docs)
    for d, (*whole, base, score) in zip(docs, tree_scores(docs, held, depth), strict=True):
        for r in got[d[0]]:
            assert [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == whole
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
            assert r["score"] == pytest.approx(score, rel=1e-9)
    assert suffix_tree.scores(empty(spark)).count() == 0


def test_op2(spark):
    docs = documents()
    sites, first = collections.defaultdict(set), {}
    key = lambda d: (d[0] is not None, d[0] or 0)
    for d in sorted(docs, key=key):
        for i, line in enumerate((d[1] if d[1] is not None else "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(d[3] or "")
                first.setdefault(line.strip(" "), (d[0], i))
    got = by_id(line_spread.clean(frame(spark)))
    removed = 0
    for d in docs:
        for r in got[d[0]]:
            if d[1] is None:
                assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
                continue
            lines = d[1].split("\n")
            kept = [x for i, x in enumerate(lines) if not x.strip(" ") or len(sites[x.strip(" ")]) < line_spread.SITES or first[x.strip(" ")] == (d[0], i)]
            assert (r["text"], r["n_lines"], r["n_removed"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
            removed += len(lines) - len(kept)
    assert removed > 10
    assert line_spread.clean(empty(spark)).count() == 0


def test_op2_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = line_spread.clean(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(line_spread.SQL).project("doc_id, n_lines, n_removed, text").fetchall())


def test_op3(spark):
    root = new_path(spark, "store")
    store = compaction.ShardStore(spark, root, target=20_000, fanout=3)
    docs = frame(spark)
    for k in range(3):
        assert store.append(docs) == k + 1
    assert len(store.manifest()["shards"]) == 9
    assert store.append(empty(spark).limit(0)) == 4
    other = compaction.ShardStore(spark, root)
    with pytest.raises(compaction.Conflict):
        other._commit({"version": 4, "schema": None, "shards": []})
    with pytest.raises(ValueError, match="columns"):
        store.append(docs.drop("text"))
    version = store.compact()
    assert 1 < len(store.manifest()["shards"]) < 9
    assert max(s["bytes"] for s in store.manifest()["shards"]) < 2 * store.target
    assert store.read(1).count() == len(documents())
    expected = sorted(map(repr, [tuple(r) for r in docs.collect()] * 3))
    assert sorted(map(repr, (tuple(r) for r in store.read(version).collect()))) == expected
    store.vacuum()
    assert store.versions() == [version]
    assert store.read().count() == 3 * len(documents())
    with pytest.raises(ValueError, match="no version"):
        compaction.ShardStore(spark, new_path(spark, "store")).read()


def test_op3_one_file(spark):
    """A table of one file arrives in several shards, which are merged to one."""
    docs = frame(spark).withColumn("arrival", F.lit("mine")).coalesce(1)
    store = compaction.ShardStore(spark, new_path(spark, "store"))
    assert store.append_dealt(docs, 8) == 8
    assert len(store.manifest()["shards"]) == 8
    assert [store.read(k).count() for k in (1, 8)] == [11, len(documents())]
    assert store.compact() == 9
    assert len(store.manifest()["shards"]) == 1
    store.vacuum()
    assert len(store._files("data")) == 1
    assert store.read().columns == docs.columns
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, docs.collect()))


def test_op4(spark):
    items = [(1, documents()[3][1]), (2, "THE of"), (3, None), (4, "..."), (None, documents()[60][1]), (5, documents()[3][1].upper()), (6, "y z y z y z y z y z y")]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words.findall(low(text))
        for k in range(max(len(w) - 10, 0) + bool(w)):
            windows[tuple(w[k : k + 10])].add("" if name is None else str(name))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (200_000, 20):
        got = by_id(positional_index.contamination(frame(spark), bench, limit))
        for d in documents():
            w, hit, names = words.findall(low(d[1])), set(), set()
            for n in {len(q) for q in windows}:
                for k in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        names |= found
            for r in got[d[0]]:
                assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == (len(w), len(hit), len(names), sorted(names), bool(hit))
    assert positional_index.contamination(empty(spark), bench).count() == 0
    none = positional_index.contamination(frame(spark), bench.limit(0))
    assert none.count() == len(documents()) and none.where("contaminated").count() == 0
    index = positional_index.build_index(frame(spark))
    near = {(r["doc_id"]) for r in positional_index.near(index, ["house", "river"], 1).collect()}
    assert near == {d[0] for d in documents() if re.search(r"house \W*river|river \W*house", low(d[1]).replace("\n", " ").replace(".", " "))}


def test_op5(spark):
    urls = [
        "http://a.org/x", "http://ORG/", "http://org", "http://borg/x", "http://m.example.org/es/1", "http://example.org/en/12?x", "http://example.org/fr", "https://x.com/fr/a", "https://x.com/de/spam",
        "http://spamfarm.net/de/spam", "http://housestone.net/fr/a#x", None, "", "no scheme", "x://y://z/a", "http://x.com/de/spam\n2", "http://" + "ab" * 300 + ".net/q",
    ]
    pages = spark.createDataFrame([(i if i else None, u, "1") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_bayes.RULES, "verdict string, host string, path string")
    texts = spark.createDataFrame([("<p>spam farm house stone</p> spam",), (None,)], "text string")
    got = url_bayes.judge(pages, rules, texts).collect()
    assert len(got) == len(pages.collect())
    found = collections.Counter((r["host"], r["path"], r["rule"]) for r in got)
    expected = collections.Counter()
    for u in urls * 2:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p) for _, h, p in url_bayes.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        expected[host, path, max(fits)[1] if fits else None] += 1
    assert found == expected
    ruled = {h + p: v for v, h, p in url_bayes.RULES}
    assert all(r["verdict"] == ruled[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got if r["host"] == "spamfarm.net"} == {"block"}
    assert {r["verdict"] for r in got if r["host"] == "housestone.net"} == {"allow"}
    assert url_bayes.judge(pages.limit(0), rules, texts).count() == 0
    assert {r["verdict"] for r in url_bayes.judge(pages, rules.limit(0), texts).collect()} == {"allow"}
    assert url_bayes.viterbi("spamfarm", [(0, 4, 5), (4, 8, 5), (0, 8, 1)], 1000) == ["spamfarm"]
    assert url_bayes.viterbi("spamfarm", [(0, 4, 500), (4, 8, 400)], 1000) == ["spam", "farm"]


def cheapest_split(label, counts):
    """The words of a label with the least cost in all, by trying every split."""
    total = sum(counts.values())

    @functools.cache
    def best(at):
        if at == len(label):
            return 0.0, ()
        tried = []
        for end in range(at + 1, min(at + url_bayes.LONGEST, len(label)) + 1):
            word = label[at:end]
            own = -math.log(counts[word] / total) if counts.get(word) and len(word) > 1 else math.log(max(total, 2)) + len(word) * math.log(10)
            cost, rest = best(end)
            tried.append((own + cost, (word, *rest)))
        return min(tried, key=lambda t: t[0])

    return best(0)[1]


def test_op5_brute_force(spark):
    """Odds and verdicts against counts in dictionaries and a search over all splits."""
    import random

    rng = random.Random(5)
    words = ["news", "shop", "spam", "cash", "house", "stone", "river", "win", "fast", "blog"]
    texts = [f"<p class='x'>{' '.join(rng.choices(words, k=rng.randint(5, 40)))}</p>" for _ in range(30)]
    urls = []
    for i in range(80):
        side = rng.random() < 0.5
        host = "".join(rng.choices(words[2:4] + words[7:9] if side else words[4:7] + words[9:], k=rng.randint(1, 4)))
        host += rng.choice(["", "24", "-x7"]) + rng.choice([".com", ".net", ".org", ".example.org"])
        path = rng.choice(["/de/", "/fr/", "/es/", "/en/1", "/en/2", "/"]) + "/".join(rng.choices(words, k=rng.randint(0, 3)))
        urls.append(f"http://{host}{path}" + rng.choice(["", "?q=1", "#top"]))
    urls += urls[:10] + [None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_bayes.RULES, "verdict string, host string, path string")
    got = {r["page_id"]: r for r in url_bayes.judge(pages, rules, spark.createDataFrame([(t,) for t in texts], "text string")).collect()}

    counts = collections.Counter(w for t in texts for w in re.findall("[a-z]{2,}", re.sub("<[^>]*>", " ", t)))
    seen, ruled = [], []
    for u in urls:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1], m[2]) if m else ("", "")
        tokens = ["." + w for label in re.findall("[a-z]+|[0-9]+", host) for w in cheapest_split(label, counts)]
        seen.append(tokens + re.findall("[a-z0-9]+", path.lower()))
        fits = [(len(h + p), v) for v, h, p in url_bayes.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        ruled.append(max(fits)[1] if fits else None)
    tables = {v: collections.Counter(t for tokens, r in zip(seen, ruled, strict=True) if r == v for t in tokens) for v in ("allow", "block")}
    known = set(tables["allow"]) | set(tables["block"])
    chance = lambda t, v: math.log((tables[v][t] + 1) / (sum(tables[v].values()) + len(known) + 1))
    assert {"allow", "block", None} <= set(ruled)
    for i, (tokens, r) in enumerate(zip(seen, ruled, strict=True)):
        odds = math.log(ruled.count("block") / ruled.count("allow")) + sum(chance(t, "block") - chance(t, "allow") for t in tokens if t in known)
        assert got[i]["odds"] == pytest.approx(odds, abs=1e-9)
        assert got[i]["verdict"] == (r or ("block" if odds > 0 else "allow"))


def test_op6(spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    kinds = (assign, r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    lengths = (lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16)
    got = by_id(randomness.digests(frame(spark)))
    for d in documents():
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, d[1] or "") if lengths[k](m))
        written = [f"{randomness.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        for r in got[d[0]]:
            assert [r[c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
            assert r["base_sha256"] == sha(",".join(written))
            assert set(written) <= set(r["spans"].split(",")) | {""}
    assert randomness.digests(empty(spark)).count() == 0


def test_op6_randomness(spark):
    """Random strings are found among long words; words are not."""
    import random

    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    syllables = ["tion", "ness", "under", "over", "inter", "ment", "able", "pre"]
    word = lambda: "".join(rng.choices(syllables, k=8))[:28]
    rows = [(i, f"{word()} and {word()}") for i in range(400)]
    keys = {i: "".join(rng.choices(alphabet, k=40)) for i in range(400, 420)}
    rows += [(i, f"see {k} here") for i, k in keys.items()]
    found = randomness.digests(spark.createDataFrame(rows, "doc_id long, text string")).where("spans <> ''").collect()
    hit = {r["doc_id"] for r in found}
    assert len(hit & set(keys)) >= 18
    assert len(hit - set(keys)) <= 2
    assert all(r["spans"] == "random:4:44" for r in found if r["doc_id"] in keys)


def test_op6_few_words(spark):
    """Random keys, lower-case ones too, are found among long paths where no plain word is; the paths are not."""
    import random

    rng = random.Random(6)
    base64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    words = ["under", "local", "share", "python", "module", "config", "server", "window", "report", "search"]
    texts = ["/".join(rng.choices(words, k=6)) for _ in range(60)]
    texts += ["".join(rng.choices(base64, k=40)) for _ in range(20)]
    texts += ["".join(rng.choices(base64[:26], k=200)) for _ in range(20)]
    found = randomness.digests(spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(texts)], "doc_id long, text string"))
    hit = {r["doc_id"] for r in found.where("spans <> ''").collect()}
    assert len(hit & set(range(60))) <= 2
    assert len(hit & set(range(60, 80))) >= 18
    assert len(hit & set(range(80, 100))) >= 18


@pytest.mark.parametrize(("n", "above"), [(4, 85), (5, 80)])
def test_op7(spark, n, above):
    sets = {}
    for d in documents():
        w = SPACE.findall(low(d[1]))
        sets[d[0]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = [i for i in sets if i is not None]
    for a in names:
        for b in names:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= above * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(parity_join.groups(frame(spark), n, above))
    for i in sets:
        for r in got[i]:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), None if i is None else find(i)), i
    assert len({find(i) for i in range(60, 72)}) == 1
    assert parity_join.groups(empty(spark), n, above).count() == 0


def test_op7_blocks(spark, monkeypatch):
    """Many near copies of one text that are not all alike: chains of links, with small blocks."""
    import random

    rng = random.Random(2)
    monkeypatch.setattr(parity_join, "BLOCK", 5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 12, 20])):
            w[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(147)} for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = parity_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_op8(spark):
    got = by_id(robust_outliers.outliers(frame(spark)))
    for d in documents():
        t = d[1] or ""
        w = SPACE.findall(t)
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        for r in got[d[0]]:
            assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts
            assert r["base_failed"] == failed
            assert not (failed and r["kept"])
    assert robust_outliers.outliers(empty(spark)).count() == 0


def test_op8_outliers(spark):
    """Texts of symbols are rejected among many plain ones."""
    import random

    rng = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(3000)]
    rows = []
    for i in range(400):
        w = rng.choices(words, k=rng.randint(80, 300))
        if i % 20 == 0:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        rows.append((i, " ".join(w), "en", "s"))
    got = robust_outliers.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] % 20 != 0) for r in got)


@pytest.mark.parametrize("bad", [0.25, 0.34, 0.42])
def test_op8_many_bad(spark, bad):
    """A group with a third or more of bad texts: all of them go, and no plain one does."""
    import random

    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(3000)]
    rows, spoilt = [], set()
    for i in range(600):
        w = rng.choices(words, k=rng.randint(80, 300))
        if i < 600 * bad:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
            spoilt.add(i)
        rows.append((i, " ".join(w), "en", "s"))
    got = robust_outliers.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == spoilt


def least_determinant(x, coverage):
    """The estimate of one group's statistics, step by step in memory."""
    p = x.shape[1]
    floors = np.array(list(robust_outliers.FEATURES.values()))
    at = lambda v, q: np.sort(v)[max(math.ceil(q * len(v)), 1) - 1]
    q = np.array([[at(x[:, i], k / 20) for k in range(21)] for i in range(p)])
    width = q[:, 10:] - q[:, :11]
    low, short = q[np.arange(p), width.argmin(1)], width.min(1)
    starts = [(c, np.diag(np.maximum(s / 1.349, floors) ** -2.0)) for c, s in ((q[:, 10], q[:, 15] - q[:, 5]), (low + short / 2, short))]

    def estimate(part):
        cov = part.T @ part / len(part) - np.outer(part.mean(0), part.mean(0)) + np.diag(floors**2)
        return part.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def distance(center, inverse):
        return np.einsum("ni,ij,nj->n", x - center, inverse, x - center)

    root = np.sqrt(np.diag(starts[0][1]))
    starts.append(estimate(starts[0][0] + np.tanh((x - starts[0][0]) * root) / root)[:2])
    ends = []
    for center, inverse in starts:
        best = (center, inverse, math.inf)
        while True:
            d = distance(*best[:2])
            new = estimate(x[d <= at(d, coverage)])
            fell = best[2] - new[2]
            best = best if best[2] < new[2] else new
            if not fell > robust_outliers.SETTLED:
                break
        ends.append(best)
    center, inverse, _ = min(ends, key=lambda e: e[2])
    scale = lambda d: max(at(d, 0.5) / robust_outliers._chi_square(p, 0.5), 1e-9)
    d = distance(center, inverse)
    center, inverse, _ = estimate(x[d <= scale(d) * robust_outliers._chi_square(p, robust_outliers.GOOD)])
    return center, inverse, scale(distance(center, inverse))


def test_op8_brute_force(spark):
    """Distances and verdicts against the same estimate in memory: a source of its own, a language, and all texts."""
    import random

    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(2000)]
    rows = []
    for i in range(330):
        lang, source = ("en", "s") if i < 160 else ("en", f"t{i % 5}") if i < 290 else ("de", "s")
        w = rng.choices(words, k=rng.randint(60, 200))
        if i % 9 == 0:
            w = [x + rng.choice(["#", "$$", "%"]) for x in w]
        rows.append((i, " ".join(w), lang, source))
    described = robust_outliers.counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "lang", "source")
    model = robust_outliers.fit(described)
    got = {r["doc_id"]: r for r in robust_outliers.judge(described, materialise(model, "mcd")).collect()}
    x = {i: np.array(r["x"]) for i, r in got.items() if not r["base_failed"]}
    assert len(x) > 300
    groups = {"source": [i for i in x if i < 160], "lang": [i for i in x if i < 290], "all": list(x)}
    models = {k: least_determinant(np.array([x[i] for i in ids]), robust_outliers.COVERAGE) for k, ids in groups.items()}
    bound = robust_outliers.HEAVY * robust_outliers._chi_square(len(robust_outliers.FEATURES), 1 - robust_outliers.TAIL)
    for i, v in x.items():
        center, inverse, scale = models["source" if i < 160 else "lang" if i < 290 else "all"]
        d = (v - center) @ inverse @ (v - center) / scale
        assert got[i]["distance"] == pytest.approx(d, rel=1e-6), i
        assert got[i]["kept"] == (d <= bound)


def test_op9(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe_transducer.digests(frame(spark), path, public_tokenizers.PATTERN))
    for d in documents():
        ids = library.encode_ordinary(d[1] or "")
        for r in got[d[0]]:
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(d[1] or ""))
    assert bpe_transducer.digests(empty(spark), path, public_tokenizers.PATTERN).count() == 0
    coded = bpe_transducer.encode(frame(spark), path, public_tokenizers.PATTERN)
    back = bpe_transducer.decode(coded, path, public_tokenizers.PATTERN)
    assert back.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0


def test_utf8_machine():
    text = "aé日\U0001f600" * 3
    data = text.encode()
    for size in (1, 2, 3, 5):
        machine = bpe_transducer.Utf8Machine()
        assert "".join(machine.feed(data[i : i + size]) for i in range(0, len(data), size)) + machine.finish() == text
    for bad in (b"\xc0\x80", b"\xe0\x80\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\xe6\x97", b"\x80a"):
        machine = bpe_transducer.Utf8Machine()
        assert "".join(machine.feed(bytes([b])) for b in bad) + machine.finish() == bad.decode("utf-8", "replace")


def test_transducer_forgets(monkeypatch):
    monkeypatch.setattr(bpe_transducer, "MAX_STATES", 40)
    monkeypatch.setattr(bpe_transducer, "MAX_WORDS", 10)
    small = bpe_transducer.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    large = bpe_transducer.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for d in documents()[:40]:
        assert small.encode(d[1]) == [i for w in large.pattern.findall(d[1]) for i in large.transducer.encode(w.encode())]


def test_op10(spark):
    docs = frame(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    got = by_id(language_id.predict(docs, model, "doc_id").withColumn("held_out", language_id.held_out()))
    for d in documents():
        for r in got[d[0]]:
            assert r["held_out"] == (d[0] is None or zlib.crc32(str(d[0]).encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1
            if not any(c.isalpha() for c in d[1] or ""):
                assert (r["lang_pred"], r["score"]) == ("und", 0)
            elif d[0] is not None and d[0] < 72:
                assert r["lang_pred"] == d[2]
    assert language_id.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None, "doc_id").collect()} == {"und"}
    assert language_id.predict(empty(spark), model, "doc_id").count() == 0


def test_op10_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    right = language_id.predict(docs.where(language_id.held_out()), model, "doc_id", "lang").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
