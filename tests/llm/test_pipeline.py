"""The pipeline's stages on the table of cases, and the entry module."""

import collections
import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from seqloom.llm import language_id, line_spread
from tests.llm.cases import documents, empty, frame

#: Names that stages use within.
CLASHING = ["n_lines", "n_removed", "gone_keys", "left_lines", "_language", "_sure", "_stays", "_leak", "extra_0", "component_id", "_spread_gone", "Text2 `x`.y"]


def clashing(df):
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    clashing(frame(spark)).write.parquet(f"{path}/documents.parquet")
    items = [(1, documents()[5][1] + " " + documents()[5][1]), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == clashing(frame(spark)).columns
        assert docs.where(" or ".join(f"`{c.replace('`', '``')}` <> 'mine'" for c in CLASHING)).count() == 0
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert docs.where("n_chars <> length(text)").count() == 0
    languages, lines, near, leaks = left
    assert not languages & {80, 81, 82, 83}
    assert set(range(72)) <= languages
    assert lines == languages
    assert near <= lines and 60 in near
    near_alone = corpus_pipeline.drop_near(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert {r["doc_id"] for r in near_alone.collect()} & set(range(60, 72)) == {60}
    assert 5 in near and 5 not in leaks
    final = corpus_pipeline.run(spark, folder)
    assert 0 < final.count() < before
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def without_lines(rows):
    """Rows (doc_id, text, source) without lines on many sources, which stay where they first occur."""
    sites, first = collections.defaultdict(set), {}
    for name, text, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate(text.split("\n")):
            if key := line.strip(" "):
                sites[key].add(source or "")
                first.setdefault(key, (name, i))
    stays = lambda name, i, line: not line or len(sites[line]) < line_spread.SITES or first[line] == (name, i)
    return [(n, "\n".join(x for i, x in enumerate(t.split("\n")) if stays(n, i, x.strip(" "))), s) for n, t, s in rows]


def without_copies(rows):
    """Of each group of near duplicates the least id; rows without an id stay, once each text."""
    sets = {}
    for name, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[name] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {name: name for name in sets if name is not None}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(n, t) for n, t, _ in rows if n is None or label[n] == n or not sets[n]}


def without_leaks(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 10]) for w in map(words, items) for k in range(max(len(w) - 10, 0) + bool(w))}
    sizes = {len(x) for x in windows}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [(n, t) for n, t in rows if clean(words(t))]


LOWER = {i: i + 32 for i in range(65, 91)}


def test_brute_force(spark, folder):
    """The rows of run() against the same stages in memory; languages are judged by the operator, whose own tests hold it."""
    import base64

    import tiktoken

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = language_id.predict(docs.select("doc_id", "text", "source"), language_id.fit(docs), "doc_id", "text", "source").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in judged if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.SURE]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = without_leaks(without_copies(without_lines(rows)), items)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(n, len(ids), sha(" ".join(map(str, ids))), sha(t)) for n, t in left for ids in [library.encode_ordinary(t)]]
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert 40 < len(got) < len(rows)
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}"
    empty(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_entry():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == [
        "op1_suffix_tree", "op2_line_spread", "op3_compaction", "op4_positional_index", "op5_url_bayes",
        "op6_randomness", "op7_parity_join", "op8_robust_outliers", "op9_bpe_transducer", "op10_language_id",
    ]
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
