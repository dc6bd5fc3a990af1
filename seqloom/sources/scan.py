"""Scans of FASTQ, FASTA and unaligned BAM files into records with a dense ordinal.

Two physical forms give the same rows:

* whole files: one task reads a file's bytes and parses them. For compressed files
  that their names don't tell, compressed BAM files and BAM files that are not blocked, and files of at most WHOLE_BYTES. A file must fit in a task (and in
  2 GB, Spark's limit for one value).
* split files: Spark's text reader splits a large FASTQ or FASTA file (plain or .bz2) at any byte,
  keeping lines whole, and streams a .gz, .xz or .zst file through one task. A first pass counts each split's lines (or records); running sums give each split its first
  ordinal. A second pass parses. FASTQ records that cross splits are put together from the first and
  last three lines of the splits, which the first pass has kept aside. A large BAM file is split in the
  same way at the marks of its compressed blocks. Where a split's first record begins is guessed from the
  form of records; the bytes between the last whole record of a split and the first of the next must then
  be whole records too, which proves the guess from the file's first record on. A file in which they are
  not is read whole.

Only Spark's readers touch the files, so any store that Spark can read will do. The numbers that go to
the tasks are 16 bytes for each split.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.errors import UnknownFileFormat
from seqloom.sources import bgzf, parsers
from seqloom.plans.workspace import new_path
from seqloom.sources.detect import COMPRESSED, by_content, by_name, in_order, order_columns
from seqloom.sources.stores import first_bytes

SCHEMA = "file string, rec_idx long, name string, sequence string, qualities string"
FIELDS = ["file", "rec_idx", "name", "sequence", "qualities"]
FORMATS = ("fasta", "fastq", "bam", "bam_no_header")
WHOLE_BYTES = 32 << 20
#: Endings that Spark's text reader decompresses, and bytes read to tell a format (a block of bzip2 at least).
STREAMED, HEAD_BYTES = (".gz", ".bz2"), 1 << 20
#: Least bytes in which a split's first BAM record is looked for, and those after which the search is given up.
GUESS_BYTES, LOST_BYTES = 1 << 18, 1 << 26
_ROWS = 1 << 14


def list_files(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """Path and length of each data file, by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(map(str, paths))).select("path", "length").collect()
    return sorted(((r["path"], r["length"]) for r in rows), key=lambda f: in_order(f[0]))


def head(spark: SparkSession, path: str) -> bytes:
    """The first decompressed bytes of a file of any size."""
    return parsers.decompress_start(first_bytes(spark, path, HEAD_BYTES))[:4]


def resolve_format(spark: SparkSession, path: str, length: int, fileformat: str | None = None) -> str:
    """The given format, else by name, else by content."""
    if fileformat is not None:
        if fileformat not in FORMATS:
            raise UnknownFileFormat(f"format {fileformat!r} is not one of {', '.join(FORMATS)}")
        return fileformat
    found = by_name(path) or by_content(head(spark, path))
    if found is None:
        raise UnknownFileFormat(f"neither name nor content tells the format of {path}")
    return found


def _batches(file: str, names: list, sequences: list, qualities: list | None) -> Iterator[pa.RecordBatch]:
    n = len(names)
    for low in range(0, n, _ROWS):
        cut = slice(low, min(low + _ROWS, n))
        rows = cut.stop - low
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([file] * rows, pa.string()),
                pa.array(np.arange(low, cut.stop)),
                pa.array(names[cut], pa.string()) if isinstance(names, list) else names[cut],
                pa.array(sequences[cut], pa.string()) if isinstance(sequences, list) else sequences[cut],
                pa.nulls(rows, pa.string()) if qualities is None else pa.array(qualities[cut], pa.string()) if isinstance(qualities, list) else qualities[cut],
            ],
            FIELDS,
        )


def _moved(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + by), *batch.columns[2:]], FIELDS)


def parse_pieces(path: str, pieces: Iterable[bytes], kind: str, keep_linebreaks: bool = False) -> Iterator[pa.RecordBatch]:
    """The records of one file's bytes, which may be compressed; a few MB are held at a time."""
    data = parsers.decompressed(pieces)
    if kind == "fastq":
        for record, columns in parsers.fastq_stream(data):
            yield from _moved(_batches(path, *columns), record)
        return
    n = 0
    for rows in parsers.fasta_stream(data, keep_linebreaks) if kind == "fasta" else parsers.bam_stream(data, kind == "bam"):
        yield from _moved(_batches(path, [r[0] for r in rows], [r[1] for r in rows], None if kind == "fasta" else [r[2] for r in rows]), n)
        n += len(rows)


def parse_file(path: str, content: bytes, kind: str, keep_linebreaks: bool = False) -> Iterator[pa.RecordBatch]:
    """The records of one file's bytes."""
    if kind == "fasta":  # whole, so that errors have their line
        rows = list(parsers.fasta_records(parsers.decompress(bytes(content)).decode("utf-8", "replace"), keep_linebreaks))
        yield from _batches(path, [r[0] for r in rows], [r[1] for r in rows], None)
    else:
        yield from parse_pieces(path, parsers.cut(content), kind)


def whole_batches(batches: Iterator[pa.RecordBatch], kinds: dict[str, str], keep_linebreaks: bool = False, detect: bool = False) -> Iterator[pa.RecordBatch]:
    """Records of batches of (path, content), a file at a time."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_buffer()
            kind = kinds.get(path) or (detect and (by_name(path) or by_content(parsers.decompress_start(memoryview(data)[:HEAD_BYTES].tobytes())[:4])))
            if not kind:
                raise UnknownFileFormat(f"neither name nor content tells the format of {path}")
            yield from parse_file(path, data, kind, keep_linebreaks)


def whole_files(files: DataFrame, kinds: dict[str, str], keep_linebreaks: bool = False, detect: bool = False) -> DataFrame:
    """Records of a frame of (path, content), batch or streaming. kinds: format by path; detect: else by name or content."""
    return files.select("path", "content").mapInArrow(lambda batches: whole_batches(batches, kinds, keep_linebreaks, detect), SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, bool]]:
    """Runs of rows of one split: file, its start, rows, whether the split begins here."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column(1).to_numpy()
        files = batch.column(0)
        cuts = [0, *(np.flatnonzero(starts[1:] != starts[:-1]) + 1).tolist(), batch.num_rows]
        if len(cuts) == 2 and files[0].as_py() != files[batch.num_rows - 1].as_py() or len(set(files.unique().to_pylist())) > 1:
            names = files.to_pylist()
            cuts = sorted({*cuts, *(i for i in range(1, len(names)) if names[i] != names[i - 1])})
        for low, high in zip(cuts, cuts[1:]):
            key = files[low].as_py(), int(starts[low])
            yield (*key, batch.slice(low, high - low), key != last)
            last = key


def _key(file: str, start: int) -> int:
    """A 64-bit name of a split."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{start}:{file}".encode(), digest_size=8).digest(), "little", signed=True)


class _Firsts:
    """The first ordinal of each split."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        keys = np.array([_key(f, s) for f, s, _ in rows], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([n for _, _, n in rows], np.int64)[order]

    def __getitem__(self, split: tuple[str, int]) -> int:
        key = _key(*split)
        at = int(np.searchsorted(self.keys, key))
        if at == len(self.keys) or self.keys[at] != key:
            raise RuntimeError(f"{split[0]} was split differently in the second pass")
        return int(self.values[at])


def _firsts(counts: DataFrame) -> tuple[DataFrame, _Firsts]:
    """counts (file, start, n) with the sum of n over earlier splits of the file."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed, _Firsts([(r["file"], r["start"], r["first"]) for r in placed.select("file", "start", "first").collect()])


def _text(spark: SparkSession, files: list[str], separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(files)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _by_file(counts: DataFrame, each: int = 1) -> dict[str, int]:
    """Records of each file, of so many lines each."""
    return {r["file"]: -(-r["n"] // each) for r in counts.groupBy("file").agg(F.sum("n").alias("n")).collect()}


def split_fastq(spark: SparkSession, files: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Records of large FASTQ files, parsed by split, and their numbers."""
    lines = _text(spark, files, "\n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n, first, last = None, 0, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([split[0]]), pa.array([split[1]]), pa.array([n]), pa.array([first], pa.list_(pa.binary())), pa.array([last], pa.list_(pa.binary()))],
                ["file", "start", "n", "head", "tail"],
            )

        for file, start, rows, begins in _blocks(batches):
            if begins:
                if split is not None:
                    yield row()
                split, n, first, last = (file, start), 0, [], []
            values = rows.column(2)
            if len(first) < 3:
                first += values.slice(0, 3 - len(first)).to_pylist()
            last = (last + values.slice(max(len(values) - 3, 0)).to_pylist())[-3:]
            n += len(values)
        if split is not None:
            yield row()

    aside = new_path(spark, "splits")  # not cache(): that would also serve a file that is written anew
    lines.mapInArrow(count, "file string, start long, n long, head array<binary>, tail array<binary>").write.parquet(aside)
    counted = spark.read.parquet(aside)
    placed, firsts = _firsts(counted)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that lie in one split."""
        at, kept = 0, None
        for file, start, rows, begins in _blocks(batches):
            values = rows.column(2)
            if begins:
                at, kept = firsts[file, start], None
                skip = min(-at % 4, len(values))
                skipping = -at % 4 - skip
            else:
                skip = min(skipping, len(values))
                skipping -= skip
            at += skip
            values = values.slice(skip)
            if kept is not None and len(kept):
                values = pa.concat_arrays([kept, values])
            whole = len(values) - len(values) % 4
            columns = parsers.fastq_columns(values.slice(0, whole), at // 4)
            for batch in _batches(file, *columns):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + at // 4), *batch.columns[2:]], FIELDS)
            at += whole
            kept = values.slice(whole)

    # lines at the ends of splits, by number in the file; of these, records that lie in no single split
    ends = placed.select(
        "file",
        "first",
        (F.col("first") + F.col("n")).alias("next"),
        F.explode(
            F.array_distinct(
                F.concat(
                    F.transform("head", lambda v, i: F.struct((F.col("first") + i).alias("line"), v.alias("value"))),
                    F.transform("tail", lambda v, i: F.struct((F.col("first") + F.col("n") - F.size("tail") + i).alias("line"), v.alias("value"))),
                )
            )
        ).alias("l"),
    ).select("file", "first", "next", "l.line", "l.value", F.floor(F.col("l.line") / 4).alias("rec_idx"))
    crossing = ends.where((F.col("rec_idx") * 4 < F.col("first")) | (F.col("rec_idx") * 4 + 4 > F.col("next")))
    joined = crossing.groupBy("file", "rec_idx").agg(F.transform(F.array_sort(F.collect_set(F.struct("line", "value"))), lambda s: s["value"]).alias("lines"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, record, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(values) < 4:
                    parsers.premature(record, len(values), True)
                columns = parsers.fastq_columns(pa.array(values, pa.binary()), record)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([record]), *columns], FIELDS)

    return lines.mapInArrow(inner, SCHEMA).unionByName(joined.select("file", "rec_idx", "lines").mapInArrow(across, SCHEMA)), _by_file(counted, 4)


def split_fasta(spark: SparkSession, files: list[str], keep_linebreaks: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Records of large FASTA files, and their numbers. The text reader cuts before lines that begin with ``>``."""
    chunks = _text(spark, files, "\n>")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str]]:
        """File, its split's start, whether the split begins here, text; the separator is put back."""
        for file, start, rows, begins in _blocks(batches):
            for i, value in enumerate(rows.column(2)):
                text = value.as_buffer().to_pybytes().decode("utf-8", "replace")
                first = begins and i == 0
                yield file, start, first, text if first and start == 0 else ">" + text

    def breaks(text: str) -> tuple[int, int]:
        """Lines up to the next text, and headers."""
        lines, headers = parsers.fasta_lines(text)
        return lines + (not text.endswith("\r")), headers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list[int]] = {}
        for file, start, _, text in texts(batches):
            own = total.setdefault((file, start), [0, 0])
            lines, headers = breaks(text)
            own[0] += headers
            own[1] += lines
        if total:
            sums = list(total.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array([x for x, _ in sums]), pa.array([y for _, y in sums])], ["file", "start", "n", "lines"])

    aside = new_path(spark, "splits")
    chunks.mapInArrow(count, "file string, start long, n long, lines long").write.parquet(aside)
    counted = spark.read.parquet(aside)
    firsts = _firsts(counted.select("file", "start", "n"))[1]
    first_lines = _firsts(counted.select("file", "start", F.col("lines").alias("n")))[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, held, name = 0, 0, [], None

        def flush() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at - n, at)), pa.array([h[0] for h in held]), pa.array([h[1] for h in held]), pa.nulls(n, pa.string())], FIELDS)

        for file, start, first, text in texts(batches):
            if first or len(held) >= _ROWS:
                if held:
                    yield flush()
                held = []
                if first:
                    at, line, name = firsts[file, start], first_lines[file, start], file
            found = list(parsers.fasta_records(text, keep_linebreaks, line))
            line += breaks(text)[0]
            held += found
            at += len(found)
        if held:
            yield flush()

    return chunks.mapInArrow(run, SCHEMA), _by_file(counted)


def stream_packed(spark: SparkSession, path: str, kind: str, keep_linebreaks: bool = False) -> DataFrame:
    """Records of a large .xz or .zst file, streamed through one task.

    The text reader gives the compressed bytes as they are, cut at newlines, or the text where Hadoop has
    a codec for the ending (.zst). One task reads its splits in their order. At most a few MB are held.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = ""

        def pieces() -> Iterator[bytes]:
            """The file's bytes; the reader drops each newline, whether or not there is one at the end."""
            given, at, size, packed = 0, 0, 0, None
            for _, start, part, _ in chain([first], blocks):
                if start < at:
                    raise RuntimeError(f"the parts of {name} do not come in their order")
                at, size = start, part.column(2)[0].as_py()
                data = b"\n".join(part.column(3).to_pylist()) + b"\n"
                given += len(data)
                packed = parsers.is_compressed(data) if packed is None else packed
                yield data[:-1] if packed and given > size else data
            if packed and given not in (size, size + 1):
                raise RuntimeError(f"{given} of {size} bytes of {name} were read")

        blocks = _blocks(batches)
        first = next(blocks, None)
        if first is not None:
            name = first[0]
            yield from parse_pieces(name, pieces(), kind, keep_linebreaks)

    return rows.coalesce(1).mapInArrow(run, SCHEMA)


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, bool]]:
    """The blocks of splits of BAM files: file, its split's start, data, whether the split begins here."""
    held, fresh = b"", False
    for file, start, rows, begins in _blocks(batches):
        if begins and held:
            break
        fresh |= begins
        for i, value in enumerate(rows.column(2)):
            if begins and i == 0 and start == 0:
                continue  # what comes before the file's first mark
            piece = held + value.as_buffer().to_pybytes()
            data = bgzf.inflate(piece)
            held = piece + bgzf.MARK if data is None else b""
            if data is not None:
                yield file, start, data, fresh
                fresh = False
    if held:
        raise EOFError("a compressed block is not complete")


class _BamSplit:
    """What the first pass learns of a split: whole records, and the bytes before and after them."""

    def __init__(self, file: str, start: int, has_header: bool) -> None:
        self.file, self.start, self.n, self.head = file, start, 0, None
        self.rest, self.again = bytearray(), 0
        self.header = has_header and start == 0
        self.lost = False

    def add(self, data: bytes, at_end: bool = False) -> None:
        if self.lost:
            return
        self.rest += data
        if self.head is None and (at_end or len(self.rest) >= self.again):
            self.again = max(2 * len(self.rest), GUESS_BYTES)  # a few tries, each on twice the bytes
            begin = self._begin()
            if begin is not None:
                self.head, self.skip = b"" if self.header else bytes(self.rest[:begin]), begin
                del self.rest[:begin]
            elif len(self.rest) > LOST_BYTES:
                self.lost, self.rest = True, bytearray()
        if self.head is not None:
            more, end = bgzf.whole_records(self.rest)
            self.n += more
            del self.rest[:end]

    def _begin(self) -> int | None:
        if self.start == 0 and not self.header:
            return 0
        if not self.header:
            return bgzf.first_record(bytes(self.rest))
        try:
            return parsers.bam_header(bytes(self.rest))[1]
        except EOFError:
            return None

    def row(self) -> pa.RecordBatch:
        self.add(b"", True)
        found = self.head is not None
        values = [self.file, self.start, -1 if self.lost else self.n, found, self.skip if found else -1, self.head if found else bytes(self.rest), bytes(self.rest) if found else b""]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["file", "start", "n", "found", "skip", "head", "tail"])


def split_bam(spark: SparkSession, files: dict[str, bool]) -> tuple[DataFrame | None, list[str], dict[str, int]]:
    """Records of large blocked BAM files (path: whether it has a header), the files that can't be split, and the numbers of records of the others."""
    blocks = _text(spark, list(files), bgzf.MARK.decode())
    headers = dict(files)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for file, start, data, begins in _inflated(batches):
            if begins:
                if split is not None:
                    yield split.row()
                split = _BamSplit(file, start, headers[file])
            split.add(data)
        if split is not None:
            yield split.row()

    aside = new_path(spark, "splits")
    blocks.mapInArrow(count, "file string, start long, n long, found boolean, skip long, head binary, tail binary").write.parquet(aside)
    # run k of a file lies after its k-th split in which a record begins
    upto = F.sum(F.col("found").cast("long")).over(Window.partitionBy("file").orderBy("start"))
    counted = spark.read.parquet(aside).withColumn("upto", upto)
    ends = counted.select("file", "start", F.when(F.col("found"), F.col("upto") - 1).otherwise(F.col("upto")).alias("run"), F.col("head").alias("data"))
    ends = ends.unionByName(counted.where("found").select("file", "start", F.col("upto").alias("run"), F.col("tail").alias("data"))).where(F.length("data") > 0)
    runs = ends.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct("start", "data"))).alias("parts"))
    runs = runs.select("file", "run", F.col("parts.data").alias("parts"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for parts in batch.column(2).to_pylist():
                data = b"".join(parts)
                n, end = bgzf.whole_records(data)
                sizes.append(n if end == len(data) else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64())], ["file", "run", "n"])

    between = {(r["file"], r["run"]): r["n"] for r in runs.mapInArrow(tally, "file string, run long, n long").collect()}
    splits = sorted(counted.select("file", "start", "n", "found", "skip", "upto").collect(), key=lambda r: (r["file"], r["start"]))
    bad = {f for (f, run), n in between.items() if n < 0 or run == 0} | {r["file"] for r in splits if r["n"] < 0}
    bad |= set(files) - {r["file"] for r in splits if r["upto"]}
    good = [f for f in files if f not in bad]
    if not good:
        return None, sorted(bad), {}
    first, skip, after, at = [], [], [], {}
    for r in splits:
        file = r["file"]
        if file in bad:
            continue
        skip.append((file, r["start"], r["skip"]))
        low = at.get(file, 0)
        first.append((file, r["start"], low))
        if r["found"]:
            after.append((file, r["upto"], low + r["n"]))
            at[file] = low + r["n"] + between.get((file, r["upto"]), 0)
    firsts, skips, afters = _Firsts(first), _Firsts(skip), _Firsts(after)

    def records(file: str, data: bytes, low: int) -> Iterator[pa.RecordBatch]:
        for batch in parse_file(file, data, "bam_no_header"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_numpy() + low), *batch.columns[2:]], FIELDS)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for file, start, data, begins in _inflated(batches):
            if begins:
                held, low, left = bytearray(), firsts[file, start], skips[file, start]
            if left < 0:
                continue  # no record begins in this split
            held += data[left:]
            left = max(left - len(data), 0)
            n, end = bgzf.whole_records(held)
            yield from records(file, bytes(held[:end]), low)
            low += n
            del held[:end]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, run, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from records(file, b"".join(parts), afters[file, run])

    chosen = _text(spark, good, bgzf.MARK.decode())
    return chosen.mapInArrow(inner, SCHEMA).unionByName(runs.where(F.col("file").isin(good)).mapInArrow(across, SCHEMA)), sorted(bad), at


def _given(spark: SparkSession, sources: list, fileformat: str | None, opener: Callable[[str, str], BinaryIO] | None, keep_linebreaks: bool) -> DataFrame:
    """Records of open binary files, of ``-`` (standard input), and of paths that an opener opens in a task."""
    rows = []
    for k, source in enumerate(sources):
        if hasattr(source, "read") or source == "-":
            data = (sys.stdin.buffer if source == "-" else source).read()
            rows.append((str(getattr(source, "name", f"stream {k}")), data.encode() if isinstance(data, str) else data))
        else:
            rows.append((str(source), None))
    files = spark.createDataFrame(rows, "path string, content binary")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None:
                    with opener(path, "rb") as f:
                        content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

    kinds = {path: resolve_format(spark, path, 0, fileformat) for path, _ in rows} if fileformat else {}
    return whole_files(files.mapInArrow(load, "path string, content binary"), kinds, keep_linebreaks, detect=True)


def scan(
    spark: SparkSession, *paths: str | BinaryIO, fileformat: str | None = None, keep_linebreaks: bool = False, whole_bytes: int = WHOLE_BYTES, ordinals: str = "file",
    opener: Callable[[str, str], BinaryIO] | None = None,
) -> DataFrame:
    """file, rec_idx, name, sequence, qualities of all files under the paths.

    rec_idx is dense from 0 in each file; with ordinals="all", it runs on over the files by path (a
    folder of part files is then one file, whose parts are ordered by append and number). Qualities are
    null for FASTA and where BAM has none. A path may also be an open binary file, or ``-`` for standard
    input, which the driver reads; with an opener, tasks open each path by opener(path, "rb"). These are
    parsed whole, one file a task.
    """
    if not paths:
        raise ValueError("at least one path is needed")
    special = [p for p in paths if opener or hasattr(p, "read") or p == "-"]
    if special:
        if len(special) < len(paths):
            raise ValueError("open files and paths cannot be scanned together")
        return _numbered(_given(spark, special, fileformat, opener, keep_linebreaks), ordinals, {} if len(special) < 2 else None)
    files = list_files(spark, *paths)
    kinds = {path: resolve_format(spark, path, length, fileformat) for path, length in files if length or by_name(path) or fileformat}
    packed = {p for p in kinds if p.lower().endswith(COMPRESSED)}
    packed |= {p for p, n in files if p in kinds and n > whole_bytes and p not in packed and parsers.is_compressed(first_bytes(spark, p, 8))}
    large_bam = [p for p, n in files if p in kinds and n > whole_bytes and kinds[p].startswith("bam")]
    blocked = {p: kinds[p] == "bam" for p in large_bam if bgzf.is_blocked(first_bytes(spark, p, bgzf.FRAME))}
    parts, sizes, many = [], {}, ordinals != "file" and len(kinds) > 1
    if blocked:
        found, unsplit, numbers = split_bam(spark, blocked)
        blocked = blocked.keys() - set(unsplit)
        parts += [found] if blocked else []
        sizes |= numbers
    streamed = {p for p, n in files if p in kinds and n > whole_bytes and p.lower().endswith(COMPRESSED) and not p.lower().endswith(STREAMED) and kinds[p] in ("fastq", "fasta")}
    for p in sorted(streamed):
        found = stream_packed(spark, p, kinds[p], keep_linebreaks)
        parts.append(found)
        if many:
            sizes |= _by_file(found.groupBy("file").agg(F.count("*").alias("n")))
    alone = {p for p, n in files if n <= whole_bytes} | set(large_bam) - set(blocked) | {p for p in packed if not p.lower().endswith(STREAMED)}
    whole = [p for p in kinds if p in alone and p not in blocked and p not in streamed]
    if whole:
        contents = spark.read.format("binaryFile").load(whole)
        parts.append(whole_files(contents, {p: kinds[p] for p in whole}, keep_linebreaks))
        if many:
            sizes |= _sizes(contents, kinds)
    for kind, read in (("fastq", split_fastq), ("fasta", lambda s, f: split_fasta(s, f, keep_linebreaks))):
        large = [p for p in kinds if kinds[p] == kind and p not in set(whole) and p not in streamed]
        if large:
            found, numbers = read(spark, large)
            parts.append(found)
            sizes |= numbers
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _numbered(out, ordinals, sizes if many else {})


def _numbered(out: DataFrame, ordinals: str, sizes: dict[str, int] | None = None) -> DataFrame:
    """Ordinals by file, or running on over all files. sizes: records by file, where they are known."""
    if ordinals == "file" or sizes is not None and len(sizes) < 2:
        return out
    if sizes is None:
        sizes = {r["file"]: r["n"] for r in out.groupBy("file").agg(F.count("*").alias("n")).collect()}
    files = sorted(sizes, key=in_order)
    before = np.cumsum([0, *(sizes[f] for f in files)])[:-1].tolist()
    moved = out.sparkSession.createDataFrame(list(zip(files, before, strict=True)), "file string, _before long")
    # one row for each file: records stay where they are read
    return out.join(F.broadcast(moved), "file").select("file", (F.col("rec_idx") + F.col("_before")).alias("rec_idx"), "name", "sequence", "qualities")


def _sizes(files: DataFrame, kinds: dict[str, str]) -> dict[str, int]:
    """Records of each whole file, by lines or lengths; 0 where bytes are not as they must be, which the parser tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    n = parsers.count_records(content.as_buffer(), kinds[path])
                except Exception:  # noqa: BLE001
                    n = 0
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["file", "n"])

    return {r["file"]: r["n"] for r in files.select("path", "content").mapInArrow(run, "file string, n long").collect()}


def bam_header(spark: SparkSession, path: str) -> bytes:
    """The header text of a BAM file."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return parsers.bam_header(parsers.decompress(bytes(row["content"])))[0]
