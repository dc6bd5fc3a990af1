"""Positional pairing: two files, one interleaved file, or N files, with mate checks.

Records pair by ordinal. In strict mode the check runs as an action of its own before the pairs are
returned: as a filter in the plan, it could be moved or dropped by the optimizer. It moves ordinals and
names only. With strict=False the pairs have a ``pair_status`` instead.

Checked pairs keep the frames that they come from, so that a sink can write each side in its order
without the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.errors import FileFormatError
from seqloom.functions.records import all_mates, are_mates, is_mate, mate_key
from seqloom.plans.workspace import new_path

RECORD = ("name", "sequence", "qualities")
_SURVEY = ["rec_idx", "name0", "name1", "parity", *RECORD]


def _record(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{c}").alias(c) for c in RECORD))


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select("rec_idx", _record().alias(name))


def _check(pairs: DataFrame) -> int:
    """pairs has ``pair_status``: ok, or what is wrong, and ``most``: records of one file. The first wrong ordinal tells, mates before counts."""
    wrong = F.when(F.col("pair_status") != "ok", F.struct(F.when(F.col("pair_status").startswith("the records"), 0).otherwise(1).alias("rank"), "rec_idx", "pair_status"))
    found = pairs.agg(F.min(wrong).alias("w"), F.max("most").alias("most")).first()
    most, first = found["most"] or 0, found["w"]
    if first is not None:
        raise FileFormatError(f"pair {first['rec_idx']}: {first['pair_status']}", None)
    return most


def sides_of(df: DataFrame) -> tuple[DataFrame, ...] | None:
    """The frames whose records checked pairs or tuples hold, if these are as pair() or zip_records() gave them."""
    return df.__dict__.get("_sides")


def _with_sides(df: DataFrame, *sides: DataFrame) -> DataFrame:
    df._sides = sides
    return df


def _names(files: tuple[DataFrame, ...]) -> DataFrame:
    """rec_idx, how many records each file has there (n0, n1 ...; most: of them), and one's name (name0, name1 ...)."""
    each = range(len(files))
    marked = [f.select("rec_idx", *(F.lit(int(j == k)).alias(f"n{j}") for j in each), *((F.col("name") if j == k else F.lit(None).cast("string")).alias(f"name{j}") for j in each)) for k, f in enumerate(files)]
    return _counted(reduce(DataFrame.unionByName, marked), len(files))


def _counted(marked: DataFrame, n: int) -> DataFrame:
    sums = [c for j in range(n) for c in (F.sum(f"n{j}").alias(f"n{j}"), F.max(f"name{j}").alias(f"name{j}"))]
    return marked.groupBy("rec_idx").agg(*sums).withColumn("most", F.greatest(*(f"n{j}" for j in range(n))) if n > 1 else F.col("n0"))


def _mated(unequal: Column, mates: Column) -> Column:
    return unequal.when(~mates, "the records' names do not match").otherwise("ok").alias("pair_status")


def _unequal(in1: Column, in2: Column) -> Column:
    return F.when(~in2, "there are more reads in file 1 than in file 2").when(~in1, "there are more reads in file 2 than in file 1")


def pair(r1: DataFrame, r2: DataFrame, strict: bool = True) -> DataFrame:
    """rec_idx, r1, r2 from the records of two files."""
    if strict:
        names = _names((r1, r2))
        if _check(names.select("rec_idx", "most", _mated(_unequal(F.col("n0") > 0, F.col("n1") > 0), is_mate("name0", "name1")))) < 2:
            return _with_sides(_side(r1, "r1").join(_side(r2, "r2"), "rec_idx"), r1, r2)
    met = _side(r1, "r1").join(_side(r2, "r2"), "rec_idx", "full_outer")
    status = _mated(_unequal(F.col("r1").isNotNull(), F.col("r2").isNotNull()), is_mate(F.col("r1.name"), F.col("r2.name")))
    met = met.select("*", status)
    if not strict:
        return met
    _check(met.withColumn("most", F.lit(0)))
    return met.drop("pair_status")


def _mates_of(parity: Column, value: Column) -> list[Column]:
    return [F.max(F.when(parity == k, value)).alias(f"r{k + 1}") for k in range(2)]


_ALONE = "the last record has no partner"


def deinterleave(records: DataFrame, strict: bool = True) -> DataFrame:
    """rec_idx, r1, r2 from the records of one file in which mates follow each other."""
    half, parity = F.floor(F.col("rec_idx") / 2), F.col("rec_idx") % 2
    met = records.groupBy(half.alias("rec_idx")).agg(*_mates_of(parity, _record()))
    if strict:
        named = records.groupBy(half.alias("rec_idx")).agg(*_mates_of(parity, F.struct("name")))
        _check(named.select("rec_idx", F.lit(0).alias("most"), _mated(F.when(F.col("r2").isNull(), _ALONE), is_mate("r1.name", "r2.name"))))
        return met
    return met.select("*", _mated(F.when(F.col("r2").isNull(), _ALONE), is_mate("r1.name", "r2.name")))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of records, where in them the first mates of pairs are, and where the records whose mate does not follow."""
    kept = None
    for batch in batches:
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        n, at = batch.num_rows, batch.column(0).to_numpy()
        first = np.flatnonzero((at[:-1] % 2 == 0) & (at[1:] == at[:-1] + 1))
        alone = np.setdiff1d(np.arange(n), np.concatenate([first, first + 1]))
        kept = None
        if n and len(alone) and alone[-1] == n - 1 and at[-1] % 2 == 0:
            kept, alone = batch.slice(n - 1), alone[:-1]
        yield batch, first, alone
    if kept is not None:
        yield kept, np.zeros(0, np.int64), np.zeros(1, np.int64)


def deinterleave_scan(records: DataFrame) -> DataFrame:
    """deinterleave() of a scan, whose partitions have runs of the file in its order, the same each time.

    Mates meet where they are read; only the records at the ends of runs are moved.
    """
    records = records.select("rec_idx", *RECORD)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, alone in _neighbours(batches):
            at, names = batch.column(0).to_numpy(), batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[first] // 2), names.take(pa.array(first)), names.take(pa.array(first + 1)), *(pa.nulls(len(first), t) for t in (pa.int64(), *[pa.string()] * 3))], _SURVEY
            )
            lone = batch.take(pa.array(alone))
            yield pa.RecordBatch.from_arrays([pa.array(at[alone] // 2), *(pa.nulls(len(alone), pa.string()) for _ in range(2)), pa.array(at[alone] % 2), *(c.cast(pa.string()) for c in lone.columns[1:])], _SURVEY)

    aside = new_path(records.sparkSession, "mates")
    records.mapInArrow(survey, "rec_idx long, name0 string, name1 string, parity long, name string, sequence string, qualities string").write.parquet(aside)
    seen = records.sparkSession.read.parquet(aside)
    parity = F.col("parity")
    marked = [F.coalesce((parity == k).cast("int"), F.lit(1)).alias(f"n{k}") for k in range(2)]
    named = [F.when(parity.isNull(), F.col(f"name{k}")).when(parity == k, F.col("name")).alias(f"name{k}") for k in range(2)]
    names = _counted(seen.select("rec_idx", *marked, *named), 2)
    if _check(names.select("rec_idx", "most", _mated(F.when(F.col("n1") < 1, _ALONE), is_mate("name0", "name1")))) > 1:
        return deinterleave(records)
    lone = seen.where(parity.isNotNull())
    apart = np.array(sorted({r["rec_idx"] for r in lone.select("rec_idx").distinct().collect()}), np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, alone in _neighbours(batches):
            at = batch.column(0).to_numpy()
            if np.isin(at[first] // 2, apart).any() or not np.isin(at[alone] // 2, apart).all():
                raise RuntimeError("the file was split differently in the second pass")
            sides = [pa.StructArray.from_arrays([c.cast(pa.string()) for c in batch.take(pa.array(first + k)).columns[1:]], RECORD) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(at[first] // 2), *sides], ["rec_idx", "r1", "r2"])

    record = "struct<name:string,sequence:string,qualities:string>"
    return records.mapInArrow(meet, f"rec_idx long, r1 {record}, r2 {record}").unionByName(lone.groupBy("rec_idx").agg(*_mates_of(parity, _record())))


def zip_records(*files: DataFrame, strict: bool = True) -> DataFrame:
    """rec_idx and an array of the records of N files."""
    if not files:
        raise ValueError("at least one file is needed")
    n = len(files)
    unequal = "the files have unequal numbers of reads"
    if strict:
        names = _names(files)
        short = F.when(F.least(*(f"n{k}" for k in range(n))) < 1, unequal) if n > 1 else F.when(F.col("n0") < 1, unequal)
        mates = are_mates(*(f"name{k}" for k in range(n))) if n > 1 else F.lit(True)
        if _check(names.select("rec_idx", "most", _mated(short, mates))) < 2:
            met = reduce(lambda a, b: a.join(b, "rec_idx"), (_side(f, f"r{k}") for k, f in enumerate(files)))
            return _with_sides(met.select("rec_idx", F.array(*(f"r{k}" for k in range(n))).alias("records")), *files)
    marked = reduce(DataFrame.unionByName, (f.select("rec_idx", F.lit(k).alias("k"), _record().alias("r")) for k, f in enumerate(files)))
    met = marked.groupBy("rec_idx").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("found"))
    met = met.select("rec_idx", F.transform("found", lambda s: s["r"]).alias("records"))
    met = met.select("*", _mated(F.when(F.size("records") < n, unequal), all_mates("records")))
    if not strict:
        return met
    _check(met.withColumn("most", F.lit(0)))
    return met.drop("pair_status")


def interleave(pairs: DataFrame) -> DataFrame:
    """The records of pairs, each pair's first before its second."""
    sides = F.posexplode(F.array("r1", "r2")).alias("mate", "r")
    return pairs.select("rec_idx", sides).select((F.col("rec_idx") * 2 + F.col("mate")).alias("rec_idx"), "r.*")


def join_mates(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Mates of two unordered sets of records, by the key form of the mate test: r1, r2."""
    left, right = r1.select(mate_key().alias("k"), _record().alias("r1")), r2.select(mate_key().alias("k"), _record().alias("r2"))
    return left.join(right, "k").select("r1", "r2")


def duplicate_names(records: DataFrame, column: str = "name") -> DataFrame:
    """Values that occur more than once, with their counts."""
    return records.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
