"""Writing records as FASTQ or FASTA text."""

from __future__ import annotations

import bz2
import gzip
import lzma
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import UnknownFileFormat
from seqloom.functions.records import fasta_text, fastq_text, problem
from seqloom.operators.pairing import RECORD, interleave, sides_of
from seqloom.sources.detect import GENERATION, by_name
from seqloom.sources.stores import file_system

#: Least rows for a part file, where there are so many.
LEAST_ROWS = 16
#: Bytes of text for a member of a compressed file.
PIECE = 4 << 20
COMPRESSIONS = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".zst": "zstd"}


def record_text(fileformat: str, two_headers: bool = False, line_length: int | None = None) -> Column:
    """A record's text after its check; an invalid record is an error when it is written."""
    if fileformat == "fastq":
        text = fastq_text(two_headers=two_headers)
    elif fileformat == "fasta":
        text = fasta_text(line_length=line_length)
    elif fileformat == "bam":
        raise NotImplementedError("writing BAM is not supported")
    else:
        raise UnknownFileFormat(f"cannot write format {fileformat!r}")
    wrong = problem()
    return F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(text).alias("value")


def output_format(path: str, fileformat: str | None = None, qualities: bool | None = None, mode: str = "w") -> str:
    """The given format, else by name, else (for new files) by whether there are qualities."""
    if fileformat is not None:
        if fileformat == "bam":
            raise NotImplementedError("writing BAM is not supported")
        if fileformat not in ("fasta", "fastq"):
            raise UnknownFileFormat(f"cannot write format {fileformat!r}")
        found = fileformat
    else:
        found = by_name(path)
        if found == "bam":
            raise NotImplementedError("writing BAM is not supported")
        if found is None and qualities is not None and mode == "w":
            found = "fastq" if qualities else "fasta"
    if found is None:
        raise UnknownFileFormat(f"the name {path!r} does not tell the format")
    if found == "fastq" and qualities is False:
        raise ValueError("FASTQ cannot be written without qualities")
    return found


def _ordered(records: DataFrame, one_part: bool) -> DataFrame:
    """Parts in the order of ordinals, each sorted; or a single one."""
    if "rec_idx" not in records.columns:
        return records.coalesce(1) if one_part else records
    if one_part:
        return records.coalesce(1).sortWithinPartitions("rec_idx")
    # bounds from the ordinals alone: a range partitioning samples whole rows, and so makes all of them twice
    most = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = records.agg(F.count("*").alias("n"), F.percentile_approx("rec_idx", [k / most for k in range(1, most)] or [1.0]).alias("bounds")).first()
    bounds = sorted(set(found["bounds"] or []))[:: max(1, -(-most * LEAST_ROWS // max(found["n"], 1)))]
    if not bounds:
        return records.coalesce(1).sortWithinPartitions("rec_idx")
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("rec_idx")))
    return records.repartitionById(len(bounds) + 1, F.when(F.col("rec_idx").isNull(), 0).otherwise(part)).sortWithinPartitions("rec_idx")


#: Hadoop's names for levels of gzip.
_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def write(
    records: DataFrame, path: str, fileformat: str | None = None, *, two_headers: bool = False, line_length: int | None = None,
    mode: str = "w", compression: str | None = None, compression_level: int = 1, one_part: bool = False, in_order: bool = True,
) -> None:
    """Write a folder of part files, in the order of rec_idx if there is one.

    mode: w replaces; a adds part files, which are written aside and then renamed so that they come
    after all that are there, in their own order. Compression (gzip, bzip2) is by name unless given;
    compression_level is gzip's.
    """
    kind = output_format(path, fileformat, True if fileformat is None else None, mode)
    rows = _ordered(records, one_part) if in_order else records
    ending = next((c for e, c in COMPRESSIONS.items() if path.lower().endswith(e)), None)
    codec = compression or ending or "none"
    if codec not in ("none", "gzip", "bzip2"):
        raise ValueError(f"{codec} is written by write_file() only")
    aside = f"{path.rstrip('/')}/_{uuid.uuid4().hex}" if mode == "a" else path
    writer = rows.select(record_text(kind, two_headers, line_length)).write.mode("overwrite").option("compression", codec)
    if codec == "gzip":
        writer = writer.option("zlib.compress.level", _LEVELS[compression_level])
    writer.text(aside)
    if mode == "a":
        _take_in(records, aside, path.rstrip("/"))


def _take_in(records: DataFrame, aside: str, path: str) -> None:
    """Rename the part files of a folder into ``path`` as its next generation."""
    fs, folder = file_system(records.sparkSession, path)
    child = lambda name: file_system(records.sparkSession, f"{path}/{name}")[1]
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    if any(n.startswith("part-") for n in names):
        last = max([0, *(int(m[1]) for n in names if (m := GENERATION.match(n)))])
        prefix = f"part-g{last + 1:06d}-"
    else:
        prefix = ""
    new = sorted((s.getPath() for s in fs.listStatus(file_system(records.sparkSession, aside)[1])), key=lambda p: p.getName())
    for p in new:
        if p.getName().startswith("part-"):
            fs.rename(p, child(prefix + p.getName()))
    fs.delete(file_system(records.sparkSession, aside)[1], True)


def _compressor(codec: str | None, level: int) -> Callable[[bytes], bytes]:
    if codec == "gzip":
        return lambda b: gzip.compress(b, level, mtime=0)
    if codec == "bzip2":
        return lambda b: bz2.compress(b, max(level, 1))
    if codec == "xz":
        return lambda b: lzma.compress(b, preset=level)
    if codec == "zstd":
        import zstandard

        return lambda b: zstandard.ZstdCompressor(level=level).compress(b)
    return lambda b: b


def write_file(records: DataFrame, path: str, fileformat: str | None = None, *, two_headers: bool = False, line_length: int | None = None, mode: str = "w", compression_level: int = 1) -> None:
    """Write one file, plain or compressed by its ending (.gz .bz2 .xz .zst).

    Tasks format and compress parts, in a folder beside the file; the driver's JVM then copies one after
    another to the file's end, as no store writes a file from several places. No record is sent to the
    driver, which holds a copy's buffer at most. write() is the parallel sink.
    """
    kind = output_format(path, fileformat, True if fileformat is None else None, mode)
    codec = next((c for e, c in COMPRESSIONS.items() if path.lower().endswith(e)), None)
    text = _ordered(records, False).select(record_text(kind, two_headers, line_length))
    framed = codec not in (None, "gzip")  # Spark's writer has no such codec, or not all of its levels
    spark, compress = records.sparkSession, _compressor(codec, compression_level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines in _pieces(batch.column(0)):
                member = compress(b"".join(x for line in lines for x in (line.as_buffer(), b"\n")))
                yield pa.RecordBatch.from_arrays([pa.array([len(member).to_bytes(8, "big") + member], pa.binary())], ["member"])

    # a failed job leaves the file as it was
    fs, target = file_system(spark, path)
    beside, parts = (file_system(spark, path + end)[1] for end in (".unfinished", ".parts"))
    try:
        rows = text.mapInArrow(run, "member binary").select(F.col("member").cast("string")) if framed else text
        writer = rows.write.mode("overwrite").option("compression", "none" if framed else codec or "none")
        if codec == "gzip":
            writer = writer.option("zlib.compress.level", _LEVELS[compression_level])
        writer.text(path + ".parts")
        found = sorted(((s.getPath(), s.getLen()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")), key=lambda p: p[0].getName())
        stream = fs.create(beside, True)
        try:
            if mode == "a" and fs.exists(target):
                before = fs.open(target)
                before.transferTo(stream)
                before.close()
            for part, length in found:
                _copy(spark, fs.open(part), stream, length if framed else None)
                fs.delete(part, False)
        finally:
            stream.close()
    finally:
        fs.delete(parts, True)
    fs.delete(target, False)
    fs.rename(beside, target)


def _pieces(lines: pa.Array) -> Iterator[pa.Array]:
    """Runs of lines of PIECE bytes, or of one line."""
    ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(lines):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")))
        yield lines.slice(low, high - low)
        low = high


def _copy(spark: SparkSession, part, stream, framed: int | None) -> None:  # noqa: ANN001
    """Copy a part file in the JVM; framed: its length, if it has members after their lengths (8 bytes) and before newlines."""
    try:
        if framed is None:
            part.transferTo(stream)
        while framed is not None and part.getPos() < framed:
            spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(part, stream, 0, part.readLong())
            part.readByte()
    finally:
        part.close()


def write_pairs(pairs: DataFrame, path1: str, path2: str, fileformat: str | None = None, **options) -> None:  # noqa: ANN003
    """r1 of each pair to one output and r2 to another. Mates are not checked."""
    if str(path1) == str(path2):
        raise ValueError("the two outputs must not be the same")
    sides = sides_of(pairs) or [pairs.select("rec_idx", f"{side}.*") for side in ("r1", "r2")]
    for path, side in zip((path1, path2), sides, strict=True):
        write(side, path, fileformat, **options)


def write_interleaved(pairs: DataFrame, path: str, fileformat: str | None = None, **options) -> None:  # noqa: ANN003
    sides = sides_of(pairs)
    if sides:
        first, second = (s.select((F.col("rec_idx") * 2 + k).alias("rec_idx"), *RECORD) for k, s in enumerate(sides))
        rows = first.unionByName(second)
    else:
        rows = interleave(pairs)
    write(rows, path, fileformat, **options)


def write_many(tuples: DataFrame, *paths: str, fileformat: str | None = None, **options) -> None:  # noqa: ANN003
    """The k-th record of each tuple (rec_idx, records) to the k-th output; all tuples must have one record for each."""
    sides = sides_of(tuples)
    wrong = len(sides) != len(paths) if sides else tuples.where(F.size("records") != len(paths)).limit(1).count()
    if wrong:
        raise ValueError(f"each tuple must have {len(paths)} records")
    for k, path in enumerate(paths):
        write(sides[k] if sides else tuples.select("rec_idx", F.col("records")[k].alias("r")).select("rec_idx", "r.*"), path, fileformat, **options)
