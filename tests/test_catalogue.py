"""Every query of the core with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from oracle_check import digest  # noqa: E402
from stemforge.plans import catalogue  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    cursor = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns) and digest(df.columns, rows) == digest(names, cursor.fetchall())


def test_ingested_files(spark):
    """The one query without SQL: chunks of files, whose ids are distinct within a book, and whose sizes keep the options."""
    rows = entry.queries()["s1_ingest"](spark, FOLDER).collect()
    assert rows and len({(r["book"], r["chunk_id"]) for r in rows}) == len(rows)
    assert all(r["token_count"] > 0 and r["text"].strip() and r["chunk_id"].startswith(f"ch{r['chapter_num']}_s{r['section_label']}_chunk_") for r in rows)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == {"s1_ingest"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
