"""Record expressions against Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import records as R
from seqloom.sources.detect import by_content, by_name, name_format


def values(spark, rows, *columns):
    n = len(rows[0])
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"c{i} string" for i in range(n)))
    return [tuple(r) for r in df.select(*columns).collect()]


def test_slices(spark):
    texts = ["", "A", "ACGTACGTAC"]
    bounds = [None, 0, 2, 30, -3, -30]
    cuts = [(a, b, s) for a, b, s in itertools.product(bounds, bounds, [None, 1, 3, -1, -2])]
    got = values(spark, [(t,) for t in texts], *(R.slice_string("c0", *c).alias(f"x{i}") for i, c in enumerate(cuts)))
    for text, row in zip(texts, got, strict=True):
        assert list(row) == [text[a:b:s] for a, b, s in cuts]
    with pytest.raises(ValueError, match="zero"):
        R.slice_string("c0", step=0)


def test_id_and_comment(spark):
    names = ["", "a", "a b", "a\tb c", "a  b", "a ", "a\t", " a", "a\x00b", "a \nb"]
    got = values(spark, [(n,) for n in names], R.read_id("c0"), R.comment("c0"))
    for name, (own, rest) in zip(names, got, strict=True):
        own_expected = re.split("[ \t\x00]", name)[0]
        tail = name[len(own_expected) + 1 :].lstrip(" \t")
        assert (own, rest) == (own_expected, tail or None), name


def mates(a, b):
    a, b = re.split("[ \t\x00]", a)[0], re.split("[ \t\x00]", b)[0]
    if a[-1:] in ("1", "2", "3") and b[-1:] in ("1", "2", "3"):
        return a[:-1] == b[:-1] and len(a) == len(b)
    return a == b


def test_mates(spark):
    rng = random.Random(5)
    names = ["abc1", "abc2", "abc4", "abc", "abc1 x", "abc\ty", "", "1", "2"]
    pairs = list(itertools.product(names, names)) + [tuple("".join(rng.choices("a124 ", k=rng.randint(0, 4))) for _ in range(2)) for _ in range(500)]
    got = values(spark, pairs, R.is_mate("c0", "c1"), R.mate_key("c0") == R.mate_key("c1"))
    for (a, b), (direct, by_key) in zip(pairs, got, strict=True):
        assert direct == by_key == mates(a, b), (a, b)
    assert values(spark, [("r/1", "r/2", "r/3 x")], R.are_mates("c0", "c1", "c2")) == [(True,)]
    with pytest.raises(TypeError):
        R.are_mates("c0")


def test_reverse_complement(spark):
    every = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn-."
    expected = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn-."[::-1]
    assert values(spark, [(every,)], R.reverse_complement("c0")) == [(expected,)]


def test_text(spark):
    rows = [("n", "ACGT", "!!!!")]
    got = values(spark, rows, R.fastq_text("c0", "c1", "c2"), R.fastq_text("c0", "c1", "c2", True), R.fasta_text("c0", "c1"), R.fasta_text("c0", "c1", 3))
    assert got == [("@n\nACGT\n+\n!!!!", "@n\nACGT\n+n\n!!!!", ">n\nACGT", ">n\nACG\nT")]
    with pytest.raises(Exception, match="without qualities"):
        values(spark, [("n", "A", None)], R.fastq_text("c0", "c1", "c2"))
    assert values(spark, [("x" * 101,), ("x" * 100,), (None,)], R.shorten("c0")) == [("x" * 97 + "...",), ("x" * 100,), (None,)]
    assert values(spark, [("!I",)], R.phred("c0")) == [([0, 40],)]


def test_problems(spark):
    rows = [("n", "A", "I"), ("é", "A", "I"), ("n", "A", "II"), ("n", "A", None), (None, "A", None)]
    got = [r[0] for r in values(spark, rows, R.problem("c0", "c1", "c2"))]
    assert got[0] is None and got[3] is None
    assert "ASCII" in got[1] and "1 characters" in got[2] and "missing" in got[4]


def test_formats(spark):
    expected = {"a.fastq": "fastq", "A.FQ.GZ": "fastq", "x_sequence.txt": "fastq", "a.fa.zst": "fasta", "b.csfa": "fasta", "b.bam": "bam", "b.txt": None, "fastq": None, ".fastq": None, "d/.fa": None}
    assert {k: by_name(k) for k in expected} == expected
    assert dict(values(spark, [(k,) for k in expected], F.col("c0"), name_format(F.col("c0")))) == expected
    assert [by_content(x) for x in (b"", b"@r", b">r", b"#c", b"BAM\x01", b"x")] == ["fastq", "fastq", "fasta", "fasta", "bam", None]
