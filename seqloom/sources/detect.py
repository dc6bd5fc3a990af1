"""Formats by file name and by first bytes, and the order of part files."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of compressed files, endings of each format, the ending that needs no dot.
COMPRESSED = (".gz", ".xz", ".bz2", ".zst")
ENDINGS = {
    "fasta": ("fasta", "fa", "fna", "csfasta", "csfa"),
    "fastq": ("fastq", "fq"),
    "bam": ("bam",),
}
SEQUENCE_TXT = "_sequence.txt"
#: What (decompressed) files begin with. An empty file counts as fastq.
FIRST_BYTES = {b"@": "fastq", b">": "fasta", b"#": "fasta", b"BAM\x01": "bam"}

#: One pattern for a name in lower case and without a compression's ending, for both engines.
_PATTERNS = {kind: rf"[^/]\.({'|'.join(endings)})$" for kind, endings in ENDINGS.items()}
_PATTERNS["fastq"] += rf"|{re.escape(SEQUENCE_TXT)}$"
_COMPRESSED = r"\.(" + "|".join(e[1:] for e in COMPRESSED) + ")$"
#: Part files of an append.
GENERATION = re.compile(r"part-g(\d+)-")


def by_name(path: str) -> str | None:
    """fasta, fastq, bam, or None if the name does not tell. One compression ending is ignored."""
    name = re.sub(_COMPRESSED, "", posixpath.basename(str(path)).lower())
    return next((kind for kind, pattern in _PATTERNS.items() if re.search(pattern, name)), None)


def name_format(path: Column) -> Column:
    """by_name() as an expression."""
    name = F.regexp_replace(F.regexp_extract(F.lower(path), r"([^/]*)$", 1), _COMPRESSED, "")
    return F.coalesce(*(F.when(name.rlike(pattern), kind) for kind, pattern in _PATTERNS.items()))


def by_content(head: bytes) -> str | None:
    """The format of a file that begins with these (decompressed) bytes."""
    return next((kind for first, kind in FIRST_BYTES.items() if head.startswith(first)), None if head else "fastq")


def in_order(path: str) -> tuple:
    """Sorts files by path, and part files of a folder by generation and number."""
    folder, name = posixpath.split(path)
    number = re.search(r"part-(\d+)", name)
    if not number:
        return (path, 0, 0, "")
    generation = GENERATION.match(name)
    return (folder, int(generation[1]) if generation else 0, int(number[1]), name)


def order_columns(path: Column) -> list[Column]:
    """in_order() as expressions."""
    number = F.nullif(F.regexp_extract(path, r"part-(\d+)[^/]*$", 1), F.lit("")).cast("long")
    generation = F.nullif(F.regexp_extract(path, r"part-g(\d+)-[^/]*$", 1), F.lit("")).cast("long")
    folder = F.when(number.isNull(), path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    return [folder, F.coalesce(generation, F.lit(0)), F.coalesce(number, F.lit(0)), path]
