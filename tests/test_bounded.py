"""What grows with the data: bytes moved by pairs and numbering, bytes of the driver and of a task."""

import lzma

import pytest
from pyspark.sql import DataFrame

from seqloom.errors import FastqFormatError, FileFormatError
from seqloom.operators import pairing
from seqloom.sources import facade, scan, sinks
from tests.test_files import frame, rows, some


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs_of(spark, n=90):
    first, second = some(n), some(n, 2, "/2")
    return first, second, pairing.pair(frame(spark, first), frame(spark, second))


def test_sides_are_written_without_the_join(spark, tmp_path, monkeypatch):
    first, second, pairs = pairs_of(spark)
    written = []
    monkeypatch.setattr(sinks, "write", lambda df, *a, f=sinks.write, **k: written.append(plan(df)) or f(df, *a, **k))
    facade.write(pairs, f"{tmp_path}/1.fastq", f"{tmp_path}/2.fastq")
    facade.write(pairs, f"{tmp_path}/both.fastq", interleaved=True)
    facade.write(pairing.zip_records(frame(spark, first), frame(spark, second), frame(spark, first)), *(f"{tmp_path}/t{k}.fastq" for k in range(3)))
    assert len(written) == 6 and not any("Join" in p or "Aggregate" in p for p in written)
    assert rows(scan.scan(spark, f"{tmp_path}/2.fastq", ordinals="all")) == second
    assert rows(scan.scan(spark, f"{tmp_path}/t2.fastq", ordinals="all")) == first
    # pairs that have been changed are written as they are
    facade.write(pairs.where("rec_idx < 10"), f"{tmp_path}/few.fastq", interleaved=True)
    assert scan.scan(spark, f"{tmp_path}/few.fastq").count() == 20


def test_mates_meet_where_they_are_read(spark, tmp_path):
    first, second, pairs = pairs_of(spark)
    path = tmp_path / "both.fastq"
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for p in zip(first, second, strict=True) for _, n, s, q in p)
    path.write_text(text)
    expected = [(i, a[1:], b[1:]) for i, (a, b) in enumerate(zip(first, second, strict=True))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1500, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for whole in (0, 1 << 20):
                got = facade.read(spark, str(path), interleaved=True, whole_bytes=whole)
                assert [(r["rec_idx"], tuple(r["r1"]), tuple(r["r2"])) for r in got.orderBy("rec_idx").collect()] == expected
                assert "name, sequence, qualities" not in "".join(x for x in plan(got).splitlines() if "Exchange" in x)
        path.write_text(text + "@last/1\nA\n+\nI\n")
        with pytest.raises(FileFormatError, match="partner"):
            facade.read(spark, str(path), interleaved=True, whole_bytes=0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_repeated_ordinals_are_kept(spark):
    one = [(0, "a/1", "A", "I"), (0, "a/1", "C", "I"), (1, "b/1", "A", "I")]
    other = [(0, "a/2", "G", "I"), (1, "b/2", "T", "I")]
    pairs = pairing.pair(frame(spark, one), frame(spark, other))
    assert sorted((r["r1"]["sequence"], r["r2"]["sequence"]) for r in pairs.collect()) == [("A", "G"), ("A", "T"), ("C", "G")]
    assert pairing.sides_of(pairs) is None


def test_ordinals_over_files_move_no_record(spark, tmp_path):
    data = some(60)
    for k in range(3):
        (tmp_path / f"{k}.fastq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for _, n, s, q in data[20 * k : 20 * k + 20]))
    for whole in (0, 1 << 20):
        found = scan.scan(spark, str(tmp_path), ordinals="all", whole_bytes=whole)
        assert rows(found) == data
        assert "BroadcastHashJoin" in plan(found)


def test_large_xz_and_zst_are_streamed(spark, tmp_path, monkeypatch):
    data = some(400)
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for _, n, s, q in data).encode()
    read = []
    monkeypatch.setattr(scan, "whole_files", lambda *a, f=scan.whole_files, **k: read.append(1) or f(*a, **k))
    monkeypatch.setattr(sinks, "PIECE", 5000)  # several streams or frames
    for ending in (".xz", ".zst"):
        path = f"{tmp_path}/x.fastq{ending}"
        sinks.write_file(frame(spark, data), path)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        for size in ("500", old):  # several splits of several batches, and one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows(scan.scan(spark, path, whole_bytes=0)) == data
    (tmp_path / "y.fastq.xz").write_bytes(lzma.compress(text[:5000]) + lzma.compress(text[5000:]))
    both = scan.scan(spark, f"{tmp_path}/x.fastq.xz", f"{tmp_path}/y.fastq.xz", whole_bytes=0, ordinals="all")
    assert rows(both) == data + [(i + 400, *r) for i, *r in data]
    assert not read
    (tmp_path / "y.fastq.xz").write_bytes(lzma.compress(text)[:-20])
    with pytest.raises(Exception, match="end mark"):
        scan.scan(spark, f"{tmp_path}/y.fastq.xz", whole_bytes=0).collect()


def test_whole_files_are_parsed_in_steps(monkeypatch):
    from seqloom.sources import parsers

    monkeypatch.setattr(parsers, "STEP", 1000)
    record = b"@r\nACGT\n+\nIIII\n"
    sizes = [b.num_rows for b in scan.parse_file("x", lzma.compress(record * 1000), "fastq")]
    assert sum(sizes) == 1000 and max(sizes) < 200
    found = [i for b in scan.parse_file("x", record * 1000, "fastq") for i in b.column(1).to_pylist()]
    assert found == list(range(1000))
    with pytest.raises(FastqFormatError) as e:
        list(scan.parse_file("x", record * 999 + b"@r\nA\n", "fastq"))
    assert e.value.line == 999 * 4 + 2


def test_one_file_without_the_driver(spark, tmp_path, monkeypatch):
    data = some(300)
    monkeypatch.setattr(sinks, "PIECE", 2000)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    for ending in ("", ".gz", ".bz2", ".xz", ".zst"):
        path = tmp_path / f"x.fastq{ending}"
        for mode in ("w", "a"):
            sinks.write_file(frame(spark, data), str(path), mode=mode)
        assert rows(scan.scan(spark, str(path))) == data + [(i + 300, *r) for i, *r in data]
    assert not [f for f in tmp_path.iterdir() if f.name.endswith((".parts", ".unfinished"))]


def test_bam_bytes_are_scanned_where_they_are_made(spark):
    from seqloom.plans.catalogue import QUERIES
    from tests.conftest import SMALL

    assert plan(QUERIES["roundtrip_ubam"](spark, SMALL)).count("MapInArrow") == 1
