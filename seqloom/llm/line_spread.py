"""Operator 2: removal of lines that many sites share, by distinct-site sketches.

Each line that is not blank is known by a 64-bit hash of its trimmed text. One aggregation gives each
line a HyperLogLog sketch of its sites, merged from partial sketches, so that a line on any number of
documents costs one small row a task. Lines whose estimate is clearly above the threshold are
boilerplate, those clearly below are not; for those near it, sites are counted exactly. Boilerplate is
removed from all documents but stays where it first occurs (least doc_id, then line).

Only DataFrame functions are used. The lines meet the few lines in question by a broadcast if these are
at most SMALL, else in a join dealt by key and SALTS parts of the lines, so that a line of very many
documents is not one task's. Texts are shuffled once, as arrays of lines, to meet the places of lines to
be removed; that takes time in proportion to the lines, however long a text is.

Nulls: a null source is a site of its own (the empty string's); a null text stays null, with no lines;
null ids come first. Blank lines are neither counted nor removed. Repeated rows are answered each.
Empty tables give empty results; other columns are kept as they are, but for n_lines and n_removed, which
are replaced. Names that begin with ``_spread_`` are used in between, and must not be in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.scratch import materialise

#: Sites from which a line counts as boilerplate; the sketch's size as a power of two, its error in standard deviations.
SITES, SKETCH, DEVIATIONS = 5, 12, 4
#: Rows of a table of keys up to which it is broadcast, and parts of the lines of a key beyond that.
SMALL, SALTS = 100_000, 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_keys(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, ``at`` (0 for the first line) and ``key`` for each line that is not blank."""
    rows = docs.select(*columns, F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    return rows.where(F.trim("line") != "").select(*columns, "at", _key(F.col("line")).alias("key"))


def _meet(lines: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """lines (with doc_id and at) joined with a written table of distinct keys."""
    if keys.count() <= SMALL:
        return lines.join(F.broadcast(keys), "key", how)
    salted = keys.withColumn("_spread_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = lines.withColumn("_spread_salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["key", "_spread_salt"], how).drop("_spread_salt")


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """key, doc_id, at: each line on ``sites`` or more sites, and where it first occurs."""
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    lines = line_keys(docs.select("doc_id", "text", site.alias("site")), "doc_id", "site")
    spread = lines.groupBy("key").agg(
        F.count("*").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH))).alias("sites"), F.min(F.struct("doc_id", "at")).alias("first")
    )
    slack = int(DEVIATIONS * 1.04 / 2 ** (SKETCH / 2) * sites) + 1
    spread = materialise(spread.where((F.col("n") >= sites) & (F.col("sites") >= sites - slack)), "spread")
    sure = spread.where(F.col("sites") > sites + slack).select("key", "first.*")
    near = spread.where(F.col("sites") <= sites + slack)
    pairs = _meet(lines, near.select("key"), "left_semi").select("key", "site").distinct()
    exact = pairs.groupBy("key").agg(F.count("*").alias("exact")).where(F.col("exact") >= sites)
    return materialise(sure.unionByName(near.join(exact, "key", "left_semi").select("key", "first.*")), "common")


def remove_lines(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs with its lines of ``common`` (of boilerplate()) taken out, and n_lines, n_removed."""
    first = common.select("key", F.col("doc_id").alias("_spread_doc"), F.col("at").alias("_spread_at"))
    text = F.xxhash64("text")  # tells rows with one id apart
    lines = line_keys(docs.select("doc_id", "text", text.alias("_spread_text")), "doc_id", "_spread_text")
    found = _meet(lines, first, "inner").where(~(F.col("doc_id").eqNullSafe(F.col("_spread_doc")) & (F.col("at") == F.col("_spread_at"))))
    gone = found.groupBy(F.col("doc_id").alias("_spread_id"), "_spread_text").agg(F.collect_set("at").alias("_spread_gone"))
    rows = docs.drop("n_lines", "n_removed").withColumn("_spread_lines", _lines(F.col("text"))).withColumn("_spread_own", text).drop("text")
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_spread_id")) & (F.col("_spread_own") == F.col("_spread_text")), "left")
    n = F.coalesce(F.size("_spread_lines"), F.lit(0))
    n = F.when(F.col("_spread_lines").isNull(), 0).otherwise(n).cast("long")
    removed = F.coalesce(F.when(F.col("_spread_gone").isNotNull(), F.size("_spread_gone")), F.lit(0)).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_spread_lines") - 1), F.col("_spread_gone"))
    left = F.when(F.col("_spread_gone").isNull(), F.col("_spread_lines")).otherwise(F.transform(stay, lambda i: F.get("_spread_lines", i)))
    out = rows.withColumns({"n_lines": n, "n_removed": removed, "text": F.array_join(left, "\n")})
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def clean(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs without cross-site boilerplate, with n_lines and n_removed (replacing columns of these names)."""
    return remove_lines(docs, boilerplate(docs, sites))


#: The same in DuckDB's SQL, with exact counts for all lines.
SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT trim(line) AS t, min(doc_id * 1000000000 + pos) AS first FROM l
  WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {SITES}
), m AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(k.first <> l.doc_id * 1000000000 + l.pos, false) AS gone
  FROM l LEFT JOIN k ON trim(l.line) = k.t
), s AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
    count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_removed
  FROM m GROUP BY doc_id
)
SELECT d.doc_id, s.text, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
