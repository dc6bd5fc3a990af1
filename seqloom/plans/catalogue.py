"""Queries over the reads view, by name, with their SQL.

Column queries apply one operation each. Round-trip queries write the view in a file format, scan the
files and return the rows; their SQL is the view itself. The view has all letters of each text.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import records as R
from seqloom.operators import chunking, pairing
from seqloom.plans.reads_view import READS_SQL, reads
from seqloom.plans.workspace import new_path
from seqloom.sources import facade, sinks
from seqloom.sources.detect import name_format
from seqloom.sources.scan import SCHEMA, scan, whole_batches

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CODES, _COMPLEMENTS = R.CODES, R.COMPLEMENTS
_ID = r"regexp_extract({0}, '^[^ \t\x00]*', 0)"
_REVCOMP = f"translate(reverse({{0}}), '{_CODES}', '{_COMPLEMENTS}')"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql follows the view's definition."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = READS_SQL + sql
        return f

    return add


def column(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """A query of rec_idx and some expressions over the view; sql: the same expressions."""
    query(f"SELECT rec_idx, {sql} FROM reads", name)(lambda spark, sf_dir: reads(spark, sf_dir).select("rec_idx", *(c.alias(k) for k, c in columns().items())))


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second reads: the other number in the name, and the reverse complement of all bases."""
    first = reads(spark, sf_dir)
    other = F.regexp_replace(R.read_id("name"), "/[123]$", "/2")
    return first.select("rec_idx", other.alias("name"), R.reverse_complement("sequence").alias("sequence"), F.reverse("qualities").alias("qualities"))


_MATES = f"""SELECT rec_idx, regexp_replace({_ID.format("name")}, '/[123]$', '/2') AS name,
  {_REVCOMP.format("sequence")} AS sequence, reverse(qualities) AS qualities FROM reads"""
_PAIRS = f"""SELECT a.rec_idx, a.name AS name1, a.sequence AS sequence1, a.qualities AS qualities1,
  b.name AS name2, b.sequence AS sequence2, b.qualities AS qualities2 FROM reads a JOIN ({_MATES}) b USING (rec_idx)"""
_ROWS = "SELECT rec_idx, name, sequence, qualities FROM reads"
_FASTA_ROWS = "SELECT rec_idx, name, sequence, CAST(NULL AS VARCHAR) AS qualities FROM reads"


def _flat(pairs: DataFrame) -> DataFrame:
    return pairs.select("rec_idx", *(F.col(f"r{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in pairing.RECORD))


# aggregates


@query("SELECT count(*) AS n_records, CAST(sum(length(sequence)) AS BIGINT) AS total_bp FROM reads")
def bp_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).agg(F.count("*").alias("n_records"), F.sum(F.length("sequence")).alias("total_bp"))


@query("SELECT source, count(*) AS n_records, CAST(sum(length(sequence)) AS BIGINT) AS total_bp FROM reads GROUP BY source")
def bp_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.length("sequence")).alias("total_bp"))


@query(f"SELECT CAST(sum(length(a.sequence) + length(b.sequence)) AS BIGINT) AS total_bp FROM reads a JOIN ({_MATES}) b USING (rec_idx)")
def paired_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairing.pair(reads(spark, sf_dir), mates(spark, sf_dir), strict=False)
    return pairs.agg(F.sum(F.length("r1.sequence") + F.length("r2.sequence")).alias("total_bp"))


@query("SELECT regexp_replace(name, '^d[0-9]*', '') AS name, count(*) AS n FROM reads GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.duplicate_names(reads(spark, sf_dir).withColumn("name", F.regexp_replace("name", "^d[0-9]*", "")))


@query("SELECT sequence, count(*) AS n FROM reads GROUP BY sequence HAVING count(*) > 1")
def dup_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.duplicate_names(reads(spark, sf_dir), "sequence")


# expressions

column(
    "read_id_comment",
    lambda: {"id": R.read_id(), "comment": R.comment()},
    _ID.format("name") + r" AS id, nullif(regexp_extract(name, '(?s)^[^ \t\x00]*[ \t\x00][ \t]*(.*)$', 1), '') AS comment",
)
column("read_len", lambda: {"n": R.record_length()}, "length(sequence) AS n")
for _name, _cut, _sql in (
    ("truncate_30", (None, 30), "left({0}, 30)"),
    ("last_30", (-30, None), "right({0}, 30)"),
    ("slice_mid", (20, 60), "substr({0}, 21, 40)"),
    ("reverse_slice", (None, None, -1), "reverse({0})"),
):
    column(_name, lambda cut=_cut: {c: R.slice_string(c, *cut) for c in ("sequence", "qualities")}, ", ".join(f"{_sql.format(c)} AS {c}" for c in ("sequence", "qualities")))
column(
    "every_third",
    lambda: {"sequence": R.slice_string("sequence", 1, None, 3)},
    r"regexp_replace(substr(sequence, 2), '(.).{0,2}', '\1', 'g') AS sequence",
)
column("char_at", lambda: {"first": R.char_at("sequence", 0), "last": R.char_at("sequence", -1)}, "nullif(left(sequence, 1), '') AS first, nullif(right(sequence, 1), '') AS last")
column("revcomp", lambda: {"sequence": R.reverse_complement(), "qualities": F.reverse("qualities")}, f"{_REVCOMP.format('sequence')} AS sequence, reverse(qualities) AS qualities")
column("fastq_text", lambda: {"value": R.fastq_text()}, "concat('@', name, chr(10), sequence, chr(10), '+', chr(10), qualities) AS value")
column("fastq_text_two_headers", lambda: {"value": R.fastq_text(two_headers=True)}, "concat('@', name, chr(10), sequence, chr(10), '+', name, chr(10), qualities) AS value")
column("fasta_text", lambda: {"value": R.fasta_text()}, "concat('>', name, chr(10), sequence) AS value")
column("fasta_wrap_60", lambda: {"value": R.fasta_text(line_length=60)}, "concat('>', name, regexp_replace(sequence, '(.{1,60})', chr(10) || '\\1', 'g')) AS value")
column("fastq_bytes_len", lambda: {"n": F.length(R.fastq_bytes())}, "CAST(length(name) + length(sequence) + length(qualities) + 6 AS INTEGER) AS n")
column("qualities_hex", lambda: {"bytes": F.hex(R.qualities_as_bytes())}, "hex(qualities) AS bytes")
column("shorten_seq", lambda: {"short": R.shorten("sequence", 40)}, "CASE WHEN length(sequence) > 40 THEN concat(left(sequence, 37), '...') ELSE sequence END AS short")
column(
    "phred_sum",
    lambda: {"total": F.aggregate(R.phred(), F.lit(0).cast("long"), lambda a, x: a + x)},
    "CAST(coalesce(list_sum(list_transform(string_split(nullif(qualities, ''), ''), lambda c: ascii(c) - 33)), 0) AS BIGINT) AS total",
)
column(
    "record_repr",
    lambda: {"shown": R.describe()},
    "concat('SequenceRecord(name=''', CASE WHEN length(name) > 100 THEN concat(left(name, 97), '...') ELSE name END, ''', sequence=''', "
    "CASE WHEN length(sequence) > 100 THEN concat(left(sequence, 97), '...') ELSE sequence END, ''', qualities=''', "
    "CASE WHEN length(qualities) > 100 THEN concat(left(qualities, 97), '...') ELSE qualities END, ''')') AS shown",
)


@query("SELECT doc_id, regexp_full_match(text, '[\\x00-\\x7F]*') AS ascii FROM documents")
def ascii_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", R.is_ascii("text").alias("ascii"))


@query(
    "SELECT rec_idx, CASE WHEN rec_idx % 3 = 0 THEN 'not ASCII' WHEN rec_idx % 3 = 1 AND length(sequence) > 0 THEN 'length' END AS problem FROM reads"
)
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = reads(spark, sf_dir).withColumn("name", F.when(F.col("rec_idx") % 3 == 0, F.concat("name", F.lit("é"))).otherwise(F.col("name")))
    broken = broken.withColumn("qualities", F.when(F.col("rec_idx") % 3 == 1, F.lit("")).otherwise(F.col("qualities")))
    what = R.problem()
    return broken.select("rec_idx", F.when(what.contains("ASCII"), "not ASCII").when(what.isNotNull(), "length").alias("problem"))


_SHIFTED = "reads a JOIN reads b ON b.rec_idx = a.rec_idx + 1"
_SQL_MATE = "length({0}) = length({1}) AND CASE WHEN right({0}, 1) IN ('1', '2', '3') AND right({1}, 1) IN ('1', '2', '3') THEN left({0}, length({0}) - 1) = left({1}, length({1}) - 1) ELSE {0} = {1} END"


def _next(spark: SparkSession, sf_dir: str, by: int = 1) -> DataFrame:
    rows = reads(spark, sf_dir).select("rec_idx", *pairing.RECORD)
    return rows.select((F.col("rec_idx") - by).alias("rec_idx"), *(F.col(c).alias(f"{c}_b") for c in pairing.RECORD))


@query(f"SELECT a.rec_idx, {_SQL_MATE.format('substr(' + _ID.format('a.name') + ', 3)', 'substr(' + _ID.format('b.name') + ', 3)')} AS mates FROM {_SHIFTED}")
def is_mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda c: F.expr(f"substring({c}, 3)")
    met = reads(spark, sf_dir).join(_next(spark, sf_dir), "rec_idx")
    met = met.select("rec_idx", R.read_id("name").alias("a"), R.read_id("name_b").alias("b"))
    return met.select("rec_idx", R.is_mate(cut("a"), cut("b")).alias("mates"))


@query(f"SELECT a.rec_idx FROM reads a JOIN ({_MATES}) b ON {_SQL_MATE.format(_ID.format('a.name'), _ID.format('b.name'))}")
def mates_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = reads(spark, sf_dir), mates(spark, sf_dir)
    met = pairing.join_mates(left, right)
    return met.select(F.regexp_extract("r1.name", r"^d(\d+)", 1).cast("long").alias("rec_idx"))


@query(f"SELECT a.rec_idx, {_SQL_MATE.format(_ID.format('a.name'), _ID.format('b.name'))} AS mates FROM reads a JOIN ({_MATES}) b USING (rec_idx)")
def records_are_mates_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = reads(spark, sf_dir)
    third = first.withColumn("name", R.read_id("name"))
    tuples = pairing.zip_records(first, mates(spark, sf_dir), third, strict=False)
    return tuples.select("rec_idx", R.all_mates("records").alias("mates"))


@query(f"SELECT a.rec_idx, a.name = b.name AND a.sequence = b.sequence AND a.qualities IS NOT DISTINCT FROM b.qualities AS same FROM reads a JOIN ({_MATES}) b USING (rec_idx)")
def record_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair(reads(spark, sf_dir), mates(spark, sf_dir), strict=False).select("rec_idx", R.equal("r1", "r2").alias("same"))


@query(
    "SELECT rec_idx, left(sequence, 30) AS sequence1, "
    + _REVCOMP.format("right(sequence, 30)")
    + " AS sequence2 FROM reads WHERE length(sequence) >= 30"
)
def simulated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).where(R.record_length() >= 30)
    return rows.select("rec_idx", R.slice_string("sequence", 0, 30).alias("sequence1"), R.reverse_complement(R.slice_string("sequence", -30)).alias("sequence2"))


_PATHS = ["a.fastq", "a.fq.gz", "b.fasta", "b.FA.xz", "c.fna.bz2", "d.csfasta", "e.csfa", "f_sequence.txt", "g.txt", "h.bam", "x/y.fq.zst", "i.fastq.gz.gz", "no", ".fastq"]


@query(
    "SELECT path, CASE WHEN regexp_matches(g, '[^/]\\.(fasta|fa|fna|csfasta|csfa)$') THEN 'fasta' WHEN regexp_matches(g, '[^/]\\.(fastq|fq)$') OR g LIKE '%\\_sequence.txt' ESCAPE '\\' THEN 'fastq' "
    "WHEN regexp_matches(g, '[^/]\\.bam$') THEN 'bam' END AS format FROM (SELECT path, regexp_replace(lower(path), '\\.(gz|xz|bz2|zst)$', '') AS g FROM (VALUES "
    + ", ".join(f"('{p}')" for p in _PATHS)
    + ") v(path))"
)
def detect_format_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", name_format(F.col("path")).alias("format"))


_NIBBLES = ["12", "48", "F1", "00", "8421"]


@query("SELECT packed, translate(packed, '0123456789ABCDEF', '=ACMGRSVTWYHKDBN') AS bases FROM (VALUES " + ", ".join(f"('{x}')" for x in _NIBBLES) + ") v(packed)")
def bam_nibble_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _NIBBLES], "packed string")
    return rows.select("packed", R.bam_bases(F.unhex("packed"), F.length("packed")).alias("bases"))


# round trips


def _scanned(spark: SparkSession, path: str, **options) -> DataFrame:  # noqa: ANN003
    return scan(spark, path, ordinals="all", **options).select("rec_idx", *pairing.RECORD)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view; its rec_idx is dense from 0, as documents' ids are."""
    return reads(spark, sf_dir).select("rec_idx", *pairing.RECORD)


def _round_trip(name: str, file: str, sql: str = _ROWS, one_file: bool = False, read: dict | None = None, **options) -> None:  # noqa: ANN003
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, file)
        (sinks.write_file if one_file else sinks.write)(_dense(spark, sf_dir), path, **options)
        return _scanned(spark, path, fileformat="fasta" if "fasta" in name else "fastq", **(read or {}))

    query(sql, name)(run)


_round_trip("roundtrip_fastq", "reads.fastq")
_round_trip("roundtrip_fastq_split", "reads.fastq", read={"whole_bytes": 0}, one_file=True)
_round_trip("roundtrip_fastq_two_headers", "reads.fastq", two_headers=True)
_round_trip("roundtrip_fastq_gz", "reads.fastq.gz")
_round_trip("roundtrip_fastq_bz2", "reads.fastq.bz2")
_round_trip("roundtrip_fastq_xz", "reads.fastq.xz", one_file=True)
_round_trip("roundtrip_fastq_zst", "reads.fastq.zst", one_file=True)
_round_trip("roundtrip_fastq_gz_split", "reads.fastq.gz", read={"whole_bytes": 0}, one_file=True)
_round_trip("roundtrip_fastq_bz2_split", "reads.fastq.bz2", read={"whole_bytes": 0}, one_file=True)
_round_trip("roundtrip_fasta", "reads.fasta", _FASTA_ROWS)
_round_trip("roundtrip_fasta_split", "reads.fasta", _FASTA_ROWS, read={"whole_bytes": 0}, one_file=True)
_round_trip("roundtrip_fasta_wrapped", "reads.fasta", _FASTA_ROWS, line_length=60)


@query(_ROWS)
def roundtrip_dos(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dos.fastq")
    text = F.concat(F.regexp_replace(R.fastq_text(), "\n", "\r\n"), F.lit("\r"))
    _dense(spark, sf_dir).repartitionByRange("rec_idx").sortWithinPartitions("rec_idx").select(text).write.text(path)
    return _scanned(spark, path, fileformat="fastq")


@query(_PAIRS)
def roundtrip_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = new_path(spark, "r1.fastq"), new_path(spark, "r2.fastq")
    facade.write(pairing.pair(_dense(spark, sf_dir), mates(spark, sf_dir)), *paths)
    return _flat(facade.read(spark, *paths, fileformat="fastq"))


@query(_PAIRS)
def roundtrip_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "both.fastq")
    facade.write(pairing.pair(_dense(spark, sf_dir), mates(spark, sf_dir)), path, interleaved=True)
    return _flat(facade.read(spark, path, interleaved=True, fileformat="fastq"))


@query(_ROWS)
def roundtrip_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [new_path(spark, f"r{k}.fastq") for k in range(3)]
    rows = _dense(spark, sf_dir)
    facade.write(pairing.zip_records(rows, mates(spark, sf_dir), rows), *paths)
    return facade.read(spark, *paths, fileformat="fastq").select("rec_idx", F.col("records")[2].alias("r")).select("rec_idx", "r.*")


@query(_ROWS + " UNION ALL SELECT rec_idx + (SELECT count(*) FROM reads), name, sequence, qualities FROM reads")
def append_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "reads.fastq")
    for mode in ("w", "a"):
        sinks.write_file(_dense(spark, sf_dir), path, mode=mode)
    return _scanned(spark, path, fileformat="fastq")


_TWICE = "SELECT rec_idx + k * (SELECT count(*) FROM reads) AS rec_idx, {0} FROM ({1}) t, (VALUES (0), (1)) v(k)"


@query(_TWICE.format("name, sequence, qualities", _ROWS))
def append_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes of several part files each to one folder."""
    path = new_path(spark, "reads.fastq")
    for mode in ("w", "a"):
        sinks.write(_dense(spark, sf_dir), path, mode=mode)
    return _scanned(spark, path)


_SIDES = "name1, sequence1, qualities1, name2, sequence2, qualities2"


@query(_TWICE.format(_SIDES, _PAIRS))
def append_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = new_path(spark, "r1.fastq"), new_path(spark, "r2.fastq")
    for mode in ("w", "a"):
        facade.write(pairing.pair(_dense(spark, sf_dir), mates(spark, sf_dir)), *paths, mode=mode)
    return _flat(facade.read(spark, *paths, fileformat="fastq"))


@query(_TWICE.format(_SIDES, _PAIRS))
def append_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "both.fastq")
    for mode in ("w", "a"):
        facade.write(pairing.pair(_dense(spark, sf_dir), mates(spark, sf_dir)), path, interleaved=True, mode=mode)
    return _flat(facade.read(spark, path, interleaved=True, fileformat="fastq"))


@query(_FASTA_ROWS)
def roundtrip_triple_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three FASTA files, told by their names."""
    paths = [new_path(spark, f"r{k}.fasta") for k in range(3)]
    rows = _dense(spark, sf_dir)
    facade.write(pairing.zip_records(rows, mates(spark, sf_dir), rows), *paths)
    return facade.read(spark, *paths).select("rec_idx", F.col("records")[2].alias("r")).select("rec_idx", "r.*")


def bam_bytes(rows: list[tuple[str, str, str | None]]) -> bytes:
    """The records of an unaligned BAM file, without a header."""
    out, codes = [], {c: i for i, c in enumerate(R.BAM_CODES)}
    for name, sequence, quality in rows:
        nibbles = [codes.get(c, 15) for c in sequence] + [0] * (len(sequence) % 2)
        packed = bytes(nibbles[i] << 4 | nibbles[i + 1] for i in range(0, len(nibbles), 2))
        q = b"\xff" * len(sequence) if quality is None else bytes(ord(c) - 33 for c in quality)
        body = struct.pack("<iiBBHHHIiii", -1, -1, len(name) + 1, 0, 4680, 0, 4, len(sequence), -1, -1, 0) + name.encode() + b"\0" + packed + q
        out.append(struct.pack("<I", len(body)) + body)
    return b"".join(out)


@query("SELECT rec_idx, name, translate(sequence, 'U', 'N') AS sequence, nullif(qualities, '') AS qualities FROM reads")
def roundtrip_ubam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAM bytes are made by tasks, one file's bytes a task, and scanned as files would be."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                ids, *fields = (c.to_pylist() for c in batch.slice(low, 500).columns)
                rows = list(zip(*fields, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, ids))]), pa.array([bam_bytes(rows)], pa.binary())], ["path", "content"])

    # in one stage: a batch of files between two would hold all files of a task
    found = _dense(spark, sf_dir).mapInArrow(lambda batches: whole_batches(pack(batches), _AnyBam()), SCHEMA)
    number = F.split("file", ",")[F.col("rec_idx").cast("int")].cast("long")
    return found.select(number.alias("rec_idx"), "name", "sequence", F.nullif("qualities", F.lit("")).alias("qualities"))


class _AnyBam(dict):
    """Every path is BAM without a header."""

    def get(self, key: str, default: str | None = None) -> str:
        return "bam_no_header"


_CHUNKS = """, p AS (
  SELECT rec_idx // 2 AS pair, sum(length(name) + 2 * length(sequence) + 6) AS width FROM reads GROUP BY 1
), q AS (
  SELECT pair, coalesce(sum(width) OVER (ORDER BY pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p
)
SELECT CAST(floor(before / 65536) AS BIGINT) AS chunk, count(*) AS n_records FROM reads JOIN q ON pair = rec_idx // 2 GROUP BY 1"""


@query(_CHUNKS)
def chunk_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in each chunk of 64 KiB of the view."""
    rows = reads(spark, sf_dir).withColumn("file", F.lit("reads"))
    return chunking.chunks(rows, 64 << 10).groupBy("chunk").agg(F.count("*").alias("n_records"))
