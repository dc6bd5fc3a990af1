"""Strict parsers: bytes or lines in, records out."""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqloom.errors import FastaFormatError, FastqFormatError

#: First bytes of compressed files; the letters of BAM's four-bit codes.
GZIP, XZ, BZ2, ZSTD = b"\x1f\x8b", b"\xfd7zXZ\x00", b"BZh", b"\x28\xb5\x2f\xfd"
BAM_CODES = "=ACMGRSVTWYHKDBN"

#: Bytes that are decompressed and parsed at a time; the last three of the mark of zstd's frames without data.
STEP, ZSTD_SKIP = 4 << 20, b"\x2a\x4d\x18"

_NEWLINE = re.compile(r"\r\n|\r|\n")
_FROM_HEX = bytes.maketrans(b"0123456789abcdef", BAM_CODES.encode())
_QUALITY = bytes((i + 33) % 256 for i in range(256))


def is_compressed(head: bytes) -> bool:
    return head.startswith((GZIP, XZ, BZ2, ZSTD))


def decompress(data: bytes) -> bytes:
    """By the first bytes, whatever the name; concatenated members are joined."""
    if data.startswith(GZIP):
        return gzip.decompress(data)
    if data.startswith(XZ):
        return lzma.decompress(data)
    if data.startswith(BZ2):
        return bz2.decompress(data)
    if data.startswith(ZSTD):
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as f:
            return f.read()
    return data


def _decompressor(head: bytes):  # noqa: ANN202
    if head.startswith(XZ):
        return lzma.LZMADecompressor()
    if head.startswith(BZ2):
        return bz2.BZ2Decompressor()
    if head.startswith(ZSTD):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(31)


def _given_out(one, data: bytes) -> Iterator[bytes]:  # noqa: ANN001
    """What a decompressor gives for more data, STEP bytes at a time where it can stop."""
    if isinstance(one, (lzma.LZMADecompressor, bz2.BZ2Decompressor)):
        yield one.decompress(data, STEP)
        while not (one.eof or one.needs_input):
            yield one.decompress(b"", STEP)
    elif type(one).__module__ == "zlib":
        yield one.decompress(data, STEP)
        while one.unconsumed_tail and not one.eof:
            yield one.decompress(one.unconsumed_tail, STEP)
    else:
        for low in range(0, len(data), 1 << 16):
            if one.eof:
                break
            yield one.decompress(data[low : low + (1 << 16)])
            if one.eof:
                one.rest = one.unused_data + data[low + (1 << 16) :]


class _Zstd:
    """A frame's decompressor, with the data after the frame."""

    def __init__(self, one) -> None:  # noqa: ANN001
        self.one, self.rest = one, b""

    def __getattr__(self, name: str):  # noqa: ANN204
        return getattr(self.one, name)


def decompressed(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """decompress() of bytes that come in pieces, in pieces: streams and frames that follow each other are joined."""
    one, head, plain = None, b"", None
    for piece in pieces:
        if plain:
            yield piece
            continue
        data = head + piece
        while data:
            if one is None:
                data = data.lstrip(b"\0") if plain is not None else data  # what may pad streams
                if len(data) < 6:
                    break
                packed = is_compressed(data) or data[1:4] == ZSTD_SKIP and plain is not None
                if not packed:
                    if plain is None:
                        plain = True
                        yield data
                    # as the libraries do, what follows the last stream and is none is left
                    data, head = b"", b""
                    if not plain:
                        return
                    break
                plain = False
                one = _decompressor(ZSTD if data[1:4] == ZSTD_SKIP else data)
                one = _Zstd(one) if type(one).__module__.startswith("zstandard") else one
            yield from (out for out in _given_out(one, data) if out)
            if not one.eof:
                data = b""
                break
            data, one = one.rest if isinstance(one, _Zstd) else one.unused_data, None
        head = data if one is None and not plain else b""
    if one is not None:
        raise EOFError("compressed data end before their end mark")
    if head and plain is None:
        yield decompress(head)


def decompress_start(data: bytes, n: int = 64) -> bytes:
    """The first n decompressed bytes (or fewer), from the first bytes of a file."""
    if data.startswith(GZIP):
        return zlib.decompressobj(31).decompress(data, n)
    if data.startswith(XZ):
        return lzma.LZMADecompressor().decompress(data, n)
    if data.startswith(BZ2):
        return bz2.BZ2Decompressor().decompress(data, n)
    if data.startswith(ZSTD):
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(data) as f:
            return f.read(n)
    return data[:n]


def fastq_lines(data: bytes) -> list[bytes]:
    """Lines as the scan sees them: a final newline ends the last line and begins none."""
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return lines


def fastq_columns(lines: pa.Array, first_record: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Names, sequences and qualities of whole records; lines: four binary values for each.

    Errors carry the file's line: record 4n + k. Of several, that of the first record is raised, and
    within it: the marks of lines 1 and 3, the second name, the lengths.
    """
    columns = [lines.take(pa.array(np.arange(k, len(lines), 4))) for k in range(4)]
    if not all(map(_ascii, columns)):
        for i, line in enumerate(lines):
            raw = line.as_buffer().to_pybytes()
            if not raw.isascii():
                at = next(k for k, byte in enumerate(raw) if byte > 127)
                raise FastqFormatError(f"non-ASCII byte in line {4 * first_record + i + 1} at place {at + 1}", None)
    head, sequence, plus, quality = (pc.replace_substring_regex(x.cast(pa.string()), r"\r$", "") if _any_cr(x) else x.cast(pa.string()) for x in columns)
    names, again = (pc.utf8_slice_codeunits(x, 1, 1 << 40) for x in (head, plus))
    checks = [
        (0, pc.invert(pc.starts_with(head, "@")), "a record must begin with '@'"),
        (2, pc.invert(pc.starts_with(plus, "+")), "the third line must begin with '+'"),
        (2, pc.and_(pc.greater(pc.utf8_length(again), 0), pc.not_equal(again, names)), "the second name differs from the first"),
        (3, pc.not_equal(pc.utf8_length(sequence), pc.utf8_length(quality)), "sequence and qualities differ in length"),
    ]
    found = [(int(np.argmax(bad)), rank, k, text) for rank, (k, flag, text) in enumerate(checks) if (bad := flag.to_numpy(zero_copy_only=False)).any()]
    if found:
        at, _, k, text = min(found)
        raise FastqFormatError(text, 4 * (first_record + at) + k)
    return names, sequence, quality


def _values(x: pa.Array) -> np.ndarray:
    data = x.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _any_cr(x: pa.Array) -> bool:
    return bool((_values(x) == 13).any())


def _ascii(x: pa.Array) -> bool:
    return bool((_values(x) < 128).all())


def fastq_stream(pieces: Iterable[bytes]) -> Iterator[tuple[int, tuple[pa.Array, pa.Array, pa.Array]]]:
    """The records of a whole file's bytes: the first one's number, and columns."""
    held, record = bytearray(), 0
    for piece in pieces:
        held += piece
        if len(held) < STEP:
            continue
        ends = np.flatnonzero(np.frombuffer(bytes(held), np.uint8) == 10)
        n = len(ends) // 4
        if n:
            end = int(ends[4 * n - 1]) + 1
            yield record, fastq_columns(pa.array(fastq_lines(bytes(held[:end])), pa.binary()), record)
            del held[:end]
            record += n
    data = bytes(held)
    lines = fastq_lines(data)
    whole = len(lines) - len(lines) % 4
    if whole:
        yield record, fastq_columns(pa.array(lines[:whole], pa.binary()), record)
    if whole < len(lines):
        premature(record + whole // 4, len(lines) - whole, data.endswith(b"\n"))


def fasta_stream(pieces: Iterable[bytes], keep_linebreaks: bool = False) -> Iterator[list[tuple[str, str]]]:
    """The records of a whole file's bytes, some at a time."""
    held, line = bytearray(), 0
    for piece in pieces:
        held += piece
        end = held.rfind(b"\n>") + 1
        if len(held) >= STEP and end:
            text = bytes(held[:end]).decode("utf-8", "replace")
            yield list(fasta_records(text, keep_linebreaks, line))
            line += fasta_lines(text)[0]
            del held[:end]
    yield list(fasta_records(bytes(held).decode("utf-8", "replace"), keep_linebreaks, line))


def bam_stream(pieces: Iterable[bytes], with_header: bool = True) -> Iterator[list[tuple[str, str, str | None]]]:
    """The records of a whole file's bytes, some at a time."""
    from seqloom.sources.bgzf import whole_records

    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) < STEP:
            continue
        if with_header:
            try:
                del held[: bam_header(bytes(held))[1]]
            except EOFError:
                continue
            with_header = False
        end = whole_records(held)[1]
        if end:
            yield list(bam_records(bytes(held[:end]), False))
            del held[:end]
    yield list(bam_records(bytes(held), with_header))


def count_records(content: bytes, kind: str) -> int:
    """How many records a file has if its bytes are as they must be."""
    if kind == "fastq":
        n, last = 0, b"\n"
        for piece in decompressed(cut(content)):
            n, last = n + piece.count(b"\n"), piece[-1:]
        return (n + (last != b"\n") + 3) // 4
    if kind == "fasta":
        return sum(map(len, fasta_stream(decompressed(cut(content)))))
    return sum(map(len, bam_stream(decompressed(cut(content)), kind == "bam")))


def cut(content: bytes) -> Iterator[bytes]:
    """Bytes in pieces of at most STEP."""
    view = memoryview(content)
    return (bytes(view[low : low + STEP]) for low in range(0, len(view), STEP))


def fastq_table(data: bytes) -> tuple[pa.Array, pa.Array, pa.Array]:
    """A whole file."""
    lines = fastq_lines(data)
    whole = len(lines) - len(lines) % 4
    out = fastq_columns(pa.array(lines[:whole], pa.binary()), 0)
    if whole < len(lines):
        premature(whole // 4, len(lines) - whole, data.endswith(b"\n"))
    return out


def premature(record: int, lines: int, ended: bool) -> None:
    """Raise for a last record of too few lines; the line is that in which the file ends."""
    raise FastqFormatError("the file ends within a record", 4 * record + lines - (not ended))


def two_headers(data: bytes) -> bool:
    """Whether the first record repeats its name on the third line."""
    lines = fastq_lines(data)
    return len(lines) > 2 and len(lines[2].rstrip(b"\r")) > 1


def fasta_lines(text: str) -> tuple[int, int]:
    """Line breaks and headers of a text."""
    lines = _NEWLINE.split(text)
    return len(lines) - 1, sum(line.strip()[:1] == ">" for line in lines)


def fasta_records(text: str, keep_linebreaks: bool = False, first_line: int = 0) -> Iterator[tuple[str, str]]:
    """name and sequence of each record; blank and ``#`` lines are skipped anywhere. first_line: the text's place in its file."""
    name, parts, joint = None, [], "\n" if keep_linebreaks else ""
    for number, raw in enumerate(_NEWLINE.split(text), first_line):
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        if line[0] == ">":
            if name is not None:
                yield _checked(name, joint.join(parts), number)
            name, parts = line[1:], []
        elif name is None:
            raise FastaFormatError(f"'>' expected before {line[:100]!r}", number)
        else:
            parts.append(line)
    if name is not None:
        yield _checked(name, joint.join(parts), None)


def _checked(name: str, sequence: str, line: int | None) -> tuple[str, str]:
    if not (name.isascii() and sequence.isascii()):
        raise FastaFormatError("non-ASCII characters", line)
    return name, sequence


def bam_header(data: bytes) -> tuple[bytes, int]:
    """The header's text and where the records begin."""
    if len(data) < 4:
        raise EOFError("truncated BAM file")
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file: wrong magic bytes")
    at = 4

    def number() -> int:
        nonlocal at
        if len(data) < at + 4:
            raise EOFError("truncated BAM file")
        at += 4
        return struct.unpack_from("<I", data, at - 4)[0]

    def skip(n: int) -> bytes:
        nonlocal at
        if len(data) < at + n:
            raise EOFError("truncated BAM file")
        at += n
        return data[at - n : at]

    text = skip(number())
    for _ in range(number()):
        skip(number() + 4)
    return text, at


def bam_records(data: bytes, with_header: bool = True) -> Iterator[tuple[str, str, str | None]]:
    """name, sequence, qualities of each unmapped single-end record."""
    at = bam_header(data)[1] if with_header else 0
    while at < len(data):
        if len(data) < at + 4 or len(data) < (end := at + 4 + struct.unpack_from("<I", data, at)[0]):
            raise EOFError("incomplete record at the end of the file")
        _, _, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHI", data, at + 4)
        if flag != 4:
            raise NotImplementedError(f"only unmapped single-end reads are supported, but a record's flag is {flag}")
        low = at + 36
        name = data[low : low + l_name - 1].decode("latin-1")
        low += l_name + 4 * n_cigar
        high = low + (l_seq + 1) // 2
        sequence = data[low:high].hex().encode().translate(_FROM_HEX)[:l_seq].decode()
        quality = data[high : high + l_seq]
        missing = l_seq > 0 and quality[:1] == b"\xff"
        yield name, sequence, None if missing else quality.translate(_QUALITY).decode("latin-1")
        at = end
