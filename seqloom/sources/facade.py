"""One entry point: what to open follows from the number of files and a few options."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from seqloom.operators import pairing
from seqloom.sources import scan as scans
from seqloom.sources import sinks


def _files(files: tuple, file1: str | None, file2: str | None, interleaved: bool, mode: str) -> list[str]:
    if mode not in ("r", "w", "a"):
        raise ValueError("mode must be 'r', 'w' or 'a'")
    if files and (file1 is not None or file2 is not None):
        if file1 is not None:
            raise ValueError("file1 cannot be given together with positional files")
        if len(files) > 1:
            raise ValueError("file2 cannot be given together with two positional files")
    elif file2 is not None and file1 is None:
        raise ValueError("file2 is given without file1")
    names = [f if hasattr(f, "read") else str(f) for f in (*files, file1, file2) if f is not None]
    if not names:
        raise ValueError("at least one file is needed")
    if interleaved and len(names) > 1:
        raise ValueError("interleaved data is in one file")
    return names


def read(spark: SparkSession, *files: str, file1: str | None = None, file2: str | None = None, fileformat: str | None = None, interleaved: bool = False, strict: bool = True, **options) -> DataFrame:  # noqa: ANN003
    """Records of one file; pairs of two, or of one interleaved file; tuples of more.

    One: file, rec_idx, name, sequence, qualities. Pairs: rec_idx, r1, r2. Tuples: rec_idx, records.
    options go to scan(). A folder of part files counts as one file; a file may also be an open binary one.
    """
    names = _files(files, file1, file2, interleaved, "r")
    frames = [scans.scan(spark, n, fileformat=fileformat, ordinals="all", **options) for n in names]
    if interleaved:
        return pairing.deinterleave_scan(frames[0]) if strict else pairing.deinterleave(frames[0], strict)
    if len(names) == 1:
        return frames[0]
    if len(names) == 2:
        return pairing.pair(*frames, strict=strict)
    return pairing.zip_records(*frames, strict=strict)


@dataclass(frozen=True)
class Record:
    """One record, for loops outside of Spark."""

    name: str
    sequence: str
    qualities: str | None = None


def iterate(records: DataFrame, sequence_class: Callable[[str, str, str | None], Any] = Record) -> Iterator[Any]:
    """Records in the order of rec_idx as objects of a class, a partition at a time."""
    rows = records.repartitionByRange("rec_idx").sortWithinPartitions("rec_idx") if "rec_idx" in records.columns else records
    for r in rows.select("name", "sequence", "qualities").toLocalIterator():
        yield sequence_class(r["name"], r["sequence"], r["qualities"])


def write(df: DataFrame, *files: str, file1: str | None = None, file2: str | None = None, fileformat: str | None = None, interleaved: bool = False, mode: str = "w", qualities: bool | None = None, **options) -> None:  # noqa: ANN003
    """Write what read() returns, by the same rules. options go to sinks.write()."""
    if mode == "r":
        raise ValueError("mode must be 'w' or 'a' for writing")
    names = _files(files, file1, file2, interleaved, mode)
    kinds = [sinks.output_format(n, fileformat, qualities, mode) for n in names]
    if interleaved:
        sinks.write_interleaved(df, names[0], kinds[0], mode=mode, **options)
    elif len(names) == 1:
        sinks.write(df, names[0], kinds[0], mode=mode, **options)
    elif len(names) == 2:
        if kinds[0] != kinds[1]:
            raise ValueError("the two outputs must have one format")
        sinks.write_pairs(df, *names, kinds[0], mode=mode, **options)
    else:
        if len(set(kinds)) > 1:
            raise ValueError("all outputs must have one format")
        sinks.write_many(df, *names, fileformat=kinds[0], mode=mode, **options)
