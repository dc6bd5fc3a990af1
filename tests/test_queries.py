"""Each query over the reads view against its SQL."""

import duckdb
import pytest

from seqloom.plans.catalogue import QUERIES, SQL
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    return con


def plain(df):
    names = sorted(df.columns)
    df = df[names].astype(object)
    return names, sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name not in SQL:
        assert len(got)
        return
    assert plain(got) == plain(tables.sql(SQL[name]).df())


def test_whole_texts(spark, tables):
    """The view has every letter of each text, and mates every base."""
    letters = tables.sql("SELECT sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) FROM documents").fetchall()[0][0]
    assert QUERIES["bp_total"](spark, SMALL).first()["total_bp"] == letters
    assert QUERIES["paired_bp"](spark, SMALL).first()["total_bp"] == 2 * letters
