"""Operations on records as column expressions; names, sequences and qualities are strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The nucleotide codes that have a complement other than themselves, and those complements.
CODES, COMPLEMENTS = "ABCDGHKMRTUVYabcdghkmrtuvy", "TVGHCDMKYAABRtvghcdmkyaabr"
BAM_CODES = "=ACMGRSVTWYHKDBN"

Value = Column | str


def _c(x: Value) -> Column:
    return F.col(x) if isinstance(x, str) else x


def read_id(name: Value = "name") -> Column:
    """The name up to its first space, tab or NUL."""
    return F.regexp_extract(_c(name), r"^[^ \t\x00]*", 0)


def comment(name: Value = "name") -> Column:
    """What follows the id and the blanks after it; null if that is nothing."""
    return F.nullif(F.regexp_extract(_c(name), r"(?s)^[^ \t\x00]*[ \t\x00][ \t]*(.*)$", 1), F.lit(""))


def record_length(sequence: Value = "sequence") -> Column:
    return F.length(_c(sequence))


def _bound(at: int | None, n: Column, default: Column) -> Column:
    """A slice bound as Python takes it: negative from the end, cut to the string."""
    if at is None:
        return default
    return F.least(F.lit(at), n) if at >= 0 else F.greatest(n + at, F.lit(0))


def _every(part: Column, step: int) -> Column:
    """The first character of each ``step``, in one pass."""
    return F.regexp_replace(part, f"(?s)(.).{{0,{step - 1}}}", "$1")


def slice_string(value: Value, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """``value[start:stop:step]`` by Python's rules."""
    x, step = _c(value), 1 if step is None else step
    n = F.length(x)
    if step == 0:
        raise ValueError("slice step cannot be zero")
    if step > 0:
        low, high = _bound(start, n, F.lit(0)), _bound(stop, n, n)
        part = x.substr(low + 1, F.greatest(high - low, F.lit(0)))
        if step == 1:
            return part
        return _every(part, step)
    # downwards: from ``first`` to just above ``last``
    first = n - 1 if start is None else F.least(F.lit(start), n - 1) if start >= 0 else n + start
    last = F.lit(-1) if stop is None else F.lit(stop) if stop >= 0 else F.greatest(n + stop, F.lit(-1))
    size = F.greatest(first - last, F.lit(0))
    part = F.reverse(x.substr(last + 2, size))
    if step == -1:
        return part
    return _every(part, -step)


def char_at(value: Value, i: int) -> Column:
    """``value[i]``; null outside of the string."""
    x = _c(value)
    at = F.lit(i) if i >= 0 else F.length(x) + i
    return F.when((at >= 0) & (at < F.length(x)), x.substr(at + 1, F.lit(1)))


def equal(a: str, b: str) -> Column:
    """Equality of two records in struct columns (name, sequence, qualities)."""
    return (F.col(f"{a}.name") == F.col(f"{b}.name")) & (F.col(f"{a}.sequence") == F.col(f"{b}.sequence")) & F.col(f"{a}.qualities").eqNullSafe(F.col(f"{b}.qualities"))


def fastq_text(name: Value = "name", sequence: Value = "sequence", qualities: Value = "qualities", two_headers: bool = False) -> Column:
    """The record as FASTQ, without the last newline; an error if it has no qualities."""
    again = _c(name) if two_headers else F.lit("")
    some = F.when(_c(qualities).isNull(), F.raise_error(F.lit("cannot write a record without qualities as FASTQ"))).otherwise(_c(qualities))
    return F.concat(F.lit("@"), _c(name), F.lit("\n"), _c(sequence), F.lit("\n+"), again, F.lit("\n"), some)


def fastq_bytes(name: Value = "name", sequence: Value = "sequence", qualities: Value = "qualities", two_headers: bool = False) -> Column:
    return F.encode(F.concat(fastq_text(name, sequence, qualities, two_headers), F.lit("\n")), "US-ASCII")


def fasta_text(name: Value = "name", sequence: Value = "sequence", line_length: int | None = None) -> Column:
    """The record as FASTA, without the last newline; an empty sequence has no line if lines are wrapped."""
    if not line_length:
        return F.concat(F.lit(">"), _c(name), F.lit("\n"), _c(sequence))
    return F.concat(F.lit(">"), _c(name), F.regexp_replace(_c(sequence), f"(.{{1,{line_length}}})", "\n$1"))


def qualities_as_bytes(qualities: Value = "qualities") -> Column:
    return F.encode(_c(qualities), "US-ASCII")


def phred(qualities: Value = "qualities") -> Column:
    """The qualities as an array of numbers."""
    return F.transform(F.filter(F.split(_c(qualities), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def reverse_complement(sequence: Value = "sequence") -> Column:
    return F.translate(F.reverse(_c(sequence)), CODES, COMPLEMENTS)


def mate_key(name: Value = "name") -> Column:
    """Equal for the names of mates and for no others: the id without a last digit 1 to 3, and whether it had one."""
    own = read_id(name)
    return F.struct(F.regexp_replace(own, "[123]$", "").alias("stem"), own.rlike("[123]$").alias("numbered"))


def is_mate(a: Value, b: Value) -> Column:
    """Whether two names belong to mates: equal ids, but for a last digit 1 to 3 that both have."""
    x, y = read_id(a), read_id(b)
    both = F.right(x, F.lit(1)).isin("1", "2", "3") & F.right(y, F.lit(1)).isin("1", "2", "3")
    stem = lambda v: v.substr(F.lit(1), F.length(v) - 1)
    return (F.length(x) == F.length(y)) & F.when(both, stem(x) == stem(y)).otherwise(x == y)


def are_mates(*names: Value) -> Column:
    """Whether all names belong to mates of the first."""
    if len(names) < 2:
        raise TypeError("at least two names are needed")
    return reduce(lambda p, q: p & q, (is_mate(names[0], n) for n in names[1:]))


def all_mates(records: Value) -> Column:
    """The same for an array of record structs."""
    r = _c(records)
    return F.forall(r, lambda x: is_mate(r[0]["name"], x["name"]))


def shorten(value: Value, n: int = 100) -> Column:
    x = _c(value)
    return F.when(F.length(x) > n, F.concat(x.substr(1, n - 3), F.lit("..."))).otherwise(x)


def is_ascii(value: Value) -> Column:
    return _c(value).rlike(r"\A[\x00-\x7F]*\z")


def problem(name: Value = "name", sequence: Value = "sequence", qualities: Value = "qualities") -> Column:
    """Why a record is not valid; null if it is."""
    n, s, q = _c(name), _c(sequence), _c(qualities)
    bad = lambda field, x: F.when(~is_ascii(x), F.concat(F.lit(f"'{field}' must be ASCII, but has "), F.regexp_extract(x, r"[^\x00-\x7F]+", 0), F.lit(" at place "), (F.length(F.regexp_extract(x, r"\A[\x00-\x7F]*", 0)) + 1).cast("string")))
    return F.coalesce(
        F.when(n.isNull(), F.lit("'name' is missing")),
        F.when(s.isNull(), F.lit("'sequence' is missing")),
        bad("name", n),
        bad("sequence", s),
        bad("qualities", q),
        F.when(F.length(s) != F.length(q), F.concat(F.lit("sequence has "), F.length(s).cast("string"), F.lit(" characters, qualities have "), F.length(q).cast("string"))),
    )


def describe(name: Value = "name", sequence: Value = "sequence", qualities: Value = "qualities") -> Column:
    """A record for display, its fields shortened."""
    shown = lambda x: F.coalesce(F.concat(F.lit("'"), shorten(x), F.lit("'")), F.lit("None"))
    return F.concat(F.lit("SequenceRecord(name="), shown(name), F.lit(", sequence="), shown(sequence), F.lit(", qualities="), shown(qualities), F.lit(")"))


def bam_bases(packed: Value, n: Value) -> Column:
    """Bases from BAM's four-bit codes, high nibble first."""
    return F.translate(F.hex(_c(packed)), "0123456789ABCDEF", BAM_CODES).substr(F.lit(1), _c(n))
