"""Parts of blocked gzip (BGZF) files, and unaligned BAM records in bytes that begin anywhere."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: A block's first bytes, and the bytes from its tenth on (extra length, BC subfield).
MAGIC, MARK = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"
#: Bytes before the mark; bytes of a block besides its data and the 8 of its check.
LEAD, FRAME = 10, 18
#: Bytes of tags beyond which (and 16 for each letter) bytes do not look like a record.
MOST_TAGS = 1 << 20


def is_blocked(head: bytes) -> bool:
    return head.startswith(MAGIC) and head[LEAD : LEAD + len(MARK)] == MARK


def inflate(piece: bytes) -> bytes | None:
    """The data of what follows a mark up to the next one; None if the block goes on, as data held a mark."""
    if len(piece) < 2:
        return None
    end = struct.unpack_from("<H", piece)[0] + 1 - FRAME + 2
    if len(piece) < end:
        return None
    data = zlib.decompress(piece[2 : end - 8], -15)
    if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", piece, end - 8):
        raise zlib.error("a block's check does not match its data")
    return data


def whole_records(data: bytes | bytearray) -> tuple[int, int]:
    """How many whole records the data begin with, and where they end."""
    n = at = 0
    while len(data) >= at + 4 and len(data) >= (end := at + 4 + struct.unpack_from("<I", data, at)[0]):
        n, at = n + 1, end
    return n, at


def _plausible(data: bytes, at: int) -> int | None:
    """Where a record that may begin here ends."""
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, mate, mate_pos = struct.unpack_from("<IiiBBHHHIii", data, at)
    tags = size - (32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq)
    if flag != 4 or not l_name or min(ref, pos, mate, mate_pos) < -1 or not 0 <= tags <= MOST_TAGS + 16 * l_seq:
        return None
    name = data[at + 36 : at + 35 + l_name]
    ended = len(data) < at + 36 + l_name or data[at + 35 + l_name] == 0
    return at + 4 + size if ended and all(32 < c < 127 for c in name) else None


def first_record(data: bytes) -> int | None:
    """The first place from which all data look like unmapped records. A guess: callers must check it."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < 36:
        return None
    last = len(x) - 36
    for at in np.flatnonzero((x[18 : last + 19] == 4) & (x[19 : last + 20] == 0)).tolist():
        end = _plausible(data, at)
        while end is not None and end <= last:
            end = _plausible(data, end)
        if end is not None:
            return at
    return None
