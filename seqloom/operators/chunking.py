"""Cuts of raw bytes and of record tables on record bounds, for work by parts."""

from __future__ import annotations

import contextlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.errors import FileFormatError, UnknownFileFormat
from seqloom.sources.detect import by_content
from seqloom.sources.parsers import bam_header

#: Pairs of records whose running sums one task makes.
RUN = 1 << 16


def _line_ends(data: bytes) -> np.ndarray:
    """Where the lines after each newline begin."""
    return np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1


def fastq_head(data: bytes) -> int:
    """Length of the longest start that holds whole pairs of records (eight lines each)."""
    at = _line_ends(data)
    whole = len(at) - len(at) % 8
    return int(at[whole - 1]) if whole else 0


def fasta_head(data: bytes) -> int:
    """Length of the start before the last header; 0 if there is no second one."""
    if data[:1] not in (b">", b"#", b""):
        raise FileFormatError("a FASTA file must begin with '>' or '#'", None)
    return data.rfind(b"\n>") + 1


def bam_head(data: bytes, end: int | None = None) -> int:
    """Length of the start that holds whole BAM records."""
    end, at = len(data) if end is None else end, 0
    while at + 4 <= end and (high := at + 4 + struct.unpack_from("<I", data, at)[0]) <= end:
        at = high
    return at


def paired_fastq_heads(a: bytes, b: bytes, end_a: int | None = None, end_b: int | None = None) -> tuple[int, int]:
    """Lengths of the longest starts with equal numbers of whole records."""
    cuts = [_line_ends(d[:e]) for d, e in ((a, end_a), (b, end_b))]
    lines = min(map(len, cuts)) // 4 * 4
    return tuple(int(c[lines - 1]) if lines else 0 for c in cuts)


def paired_fasta_heads(a: bytes, b: bytes, end_a: int | None = None, end_b: int | None = None) -> tuple[int, int]:
    """The same for FASTA: both are cut before as many headers as the one with fewer has."""
    found = []
    for d, e in ((a, end_a), (b, end_b)):
        d, at, cuts = d[: len(d) if e is None else e], 0, []
        while (at := d.find(b"\n>", at)) >= 0:
            at += 1
            cuts.append(at)
        found.append(cuts)
    n = min(map(len, found))
    return tuple(c[n - 1] if n else 0 for c in found)


class _Held:
    """A binary stream and the bytes of it that no chunk has taken yet."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.data, self.ended = stream, b"", False

    def fill(self, size: int) -> bytes:
        """Read until ``size`` bytes are held or the stream ends."""
        while not self.ended and len(self.data) < size:
            more = self.stream.read(size - len(self.data))
            self.ended = not more
            self.data += more
        return self.data

    def take(self, n: int) -> bytes:
        out, self.data = self.data[:n], self.data[n:]
        return out


def _opened(source: str | BinaryIO) -> contextlib.AbstractContextManager[BinaryIO]:
    return contextlib.nullcontext(source) if hasattr(source, "read") else open(source, "rb")


def read_chunks(source: str | BinaryIO, size: int = 4 << 20) -> Iterator[bytes]:
    """Chunks of whole records, of at most ``size`` bytes, of a file or a stream of decompressed bytes.

    Chunks of FASTQ but the last hold whole pairs of records; those of BAM hold no header. An empty file
    has no chunks. A record (a pair, in FASTQ) that does not fit raises OverflowError.
    """
    with _opened(source) as stream:
        held = _Held(stream)
        if not held.fill(4):
            return
        kind = by_content(held.data)
        if kind is None:
            raise UnknownFileFormat(f"the first bytes {held.data!r} tell no known format")
        if kind == "bam":
            want = size
            while True:
                try:
                    held.take(bam_header(held.fill(want))[1])
                    break
                except EOFError:
                    if held.ended:
                        raise
                    want *= 2
        head = {"fastq": fastq_head, "fasta": fasta_head, "bam": bam_head}[kind]
        while held.fill(size):
            cut = len(held.data) if held.ended else head(held.data)
            if not cut:
                raise OverflowError(f"a record does not fit in a chunk of {size} bytes")
            yield held.take(cut)


def _records(kind: str, data: bytes) -> float:
    """Records in the last chunk of a file, the last of which may lack its final newline."""
    if kind == "fasta":
        return data.startswith(b">") + data.count(b"\n>")
    return (data.count(b"\n") + (not data.endswith(b"\n") and bool(data))) / 4


def read_paired_chunks(first: str | BinaryIO, second: str | BinaryIO, size: int = 4 << 20) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of two FASTQ or two FASTA files, with equal numbers of whole records in both.

    Two empty files have no chunks. FileFormatError: files of different formats, other formats, or of
    different numbers of records. ValueError: a record that does not fit in ``size`` bytes.
    """
    with _opened(first) as f, _opened(second) as g:
        pair = _Held(f), _Held(g)
        starts = [h.fill(1) for h in pair]
        if not any(starts):
            return
        if not all(starts):
            raise FileFormatError(f"file {1 + starts.index(b'')} of the pair is empty and the other is not", None)
        kinds = {by_content(s) for s in starts}
        kind = kinds.pop()
        if kinds or kind not in ("fastq", "fasta"):
            raise FileFormatError("both files of a pair must be FASTQ or both FASTA", None)
        heads = paired_fastq_heads if kind == "fastq" else paired_fasta_heads
        while any([h.fill(size) for h in pair]):
            if all(h.ended for h in pair):
                if len({_records(kind, h.data) for h in pair}) > 1:
                    raise FileFormatError("one file of the pair has ended, and there is more data in the other file", None)
                yield tuple(h.take(len(h.data)) for h in pair)
                return
            cuts = heads(*(h.data for h in pair))
            if not any(cuts):
                if any(h.ended for h in pair):
                    raise FileFormatError("one file of the pair has ended, and there is more data in the other file", None)
                raise ValueError(f"records do not fit in chunks of {size} bytes")
            yield tuple(h.take(n) for h, n in zip(pair, cuts, strict=True))


def byte_chunks(data: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """read_chunks() of bytes in memory, where a chunk grows if one record is longer than ``size``."""
    kind = by_content(data[:4])
    if kind is None:
        raise UnknownFileFormat("the first bytes tell no known format")
    low = bam_header(data)[1] if kind == "bam" else 0
    head = {"fastq": fastq_head, "fasta": fasta_head, "bam": bam_head}[kind]
    while low < len(data):
        want = size
        while low + want < len(data) and not (cut := head(data[low : low + want])):
            want *= 2
        cut = cut if low + want < len(data) else len(data) - low
        yield data[low : low + cut]
        low += cut


def chunks(records: DataFrame, size: int = 4 << 20) -> DataFrame:
    """Add ``chunk`` to records (file, rec_idx, ...): runs of about ``size`` characters, cut at even ordinals.

    Mates of an interleaved file stay together, and the same cuts hold for a mate file that is joined
    by ordinal. A chunk is an independent unit of work, as a partition of a scan is.
    """
    width = F.length("name") + 2 * F.length("sequence") + 6
    pairs = records.groupBy("file", F.floor(F.col("rec_idx") / 2).alias("pair")).agg(F.sum(width).alias("width"))
    # running sums in two steps, so that no task sorts a whole file
    run = F.floor(F.col("pair") / RUN)
    runs = pairs.groupBy("file", run.alias("run")).agg(F.sum("width").alias("width"))
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("file", "run", F.coalesce(F.sum("width").over(earlier("run", "file")), F.lit(0)).alias("before"))
    inner = pairs.withColumn("run", run).withColumn("inner", F.coalesce(F.sum("width").over(earlier("pair", "file", "run")), F.lit(0)))
    placed = inner.join(before, ["file", "run"]).select("file", "pair", F.floor((F.col("before") + F.col("inner")) / size).alias("chunk"))
    return records.withColumn("pair", F.floor(F.col("rec_idx") / 2)).join(placed, ["file", "pair"]).drop("pair")
