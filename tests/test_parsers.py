"""Strict parsing of bytes, without Spark."""

import bz2
import gzip
import lzma
import struct

import pytest

from seqloom.errors import FastaFormatError, FastqFormatError
from seqloom.plans.catalogue import bam_bytes
from seqloom.sources import parsers


def fastq(data):
    return list(zip(*(c.to_pylist() for c in parsers.fastq_table(data)), strict=True))


def line_of(data):
    with pytest.raises(FastqFormatError) as e:
        fastq(data)
    return e.value.line


def test_fastq_records():
    data = b"@one more\nGATTACA\n+\nABCDEFG\n@two\nNN\n+\n!~\n"
    assert fastq(data) == [("one more", "GATTACA", "ABCDEFG"), ("two", "NN", "!~")]
    assert fastq(data[:-1]) == fastq(data)
    assert fastq(data.replace(b"\n", b"\r\n")) == fastq(data)
    assert fastq(b"") == []
    assert fastq(b"@\n\n+\n\n") == [("", "", "")]


@pytest.mark.parametrize(
    ("data", "line"),
    [
        (b"@", 0),
        (b"@r", 0),
        (b"@r\n", 1),
        (b"@r\nA", 1),
        (b"@r\nAC\n", 2),
        (b"@r\nAC\n+", 2),
        (b"@r\nAC\n+\n", 3),
        (b"@r\n\n+\n", 3),
        (b"@r\nA\n+\nH\n\n", 5),
        (b"@r\nA\n+\nH\n@s", 4),
        (b"r\nA\n+\nH\n", 0),
        (b"@r\nA\nx\nH\n", 2),
        (b"@r\nA\n+s\nH\n", 2),
        (b"@r\nA\n+\nHH\n", 3),
        (b"@r\nA\n+\nH\n@s\nAC\n+\nH\n", 7),
        (b"@r\nA\n+s\nHH\n", 2),
        (b"@r\nA\n+\nHH\ns\nA\n+\nH\n", 3),
    ],
)
def test_fastq_errors(data, line):
    assert line_of(data) == line


def test_fastq_not_ascii():
    assert line_of(b"@r\n\xc4\n+\nH\n") is None


def test_two_headers():
    assert parsers.two_headers(b"@r\nA\n+r\nH\n")
    assert not parsers.two_headers(b"@r\nA\n+\r\nH\n")


def test_fasta():
    text = "# c\n\n >one x \nAC\n# inside\nGT\r>two\rT\n>\n>empty"
    assert list(parsers.fasta_records(text)) == [("one x", "ACGT"), ("two", "T"), ("", ""), ("empty", "")]
    assert list(parsers.fasta_records(">a\nAC\nGT\n", True)) == [("a", "AC\nGT")]
    assert list(parsers.fasta_records("# only\n")) == []
    with pytest.raises(FastaFormatError) as e:
        list(parsers.fasta_records("#\nACGT\n>a\n"))
    assert e.value.line == 1
    with pytest.raises(FastaFormatError) as e:
        list(parsers.fasta_records(">a\nÄ\n>b\n"))
    assert e.value.line == 2


ROWS = [("r1", "ACGTN", "IIII!"), ("r2", "", ""), ("none", "GATTACA", None)]


def test_bam():
    header = b"BAM\x01" + struct.pack("<I", 3) + b"@HD" + struct.pack("<II", 1, 3) + b"ab\0" + struct.pack("<I", 9)
    data = bam_bytes(ROWS)
    assert list(parsers.bam_records(data, False)) == ROWS
    assert list(parsers.bam_records(header + data)) == ROWS
    assert parsers.bam_header(header + data) == (b"@HD", len(header))
    first = len(bam_bytes(ROWS[:1]))
    for cut in range(1, first):
        with pytest.raises(EOFError):
            list(parsers.bam_records(data[:cut], False))
    for cut in range(len(header)):
        with pytest.raises(EOFError):
            parsers.bam_header(header[:cut])
    with pytest.raises(ValueError, match="magic"):
        parsers.bam_header(b"SAM\x01aaaaaaaaa")
    mapped = bytearray(data)
    mapped[18] = 99
    with pytest.raises(NotImplementedError):
        list(parsers.bam_records(bytes(mapped), False))


def test_decompress():
    import zstandard

    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress, bytes):
        assert parsers.decompress(pack(b"@r\n") + pack(b"A\n")) == b"@r\nA\n"
