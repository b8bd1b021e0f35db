"""Every registered query with SQL, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__
from sparkloom import queries as reference

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool | str):
        return value
    return round(float(value), 6) + 0.0


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_query_is_its_sql(spark, sf, db, name):
    df = reference.QUERIES[name](spark, sf)
    found = db.execute(reference.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_other_queries_without_the_training_data_operators(monkeypatch):
    """Whatever can't be imported, the queries of the feature tables are there."""
    import sys

    for name in [m for m in sys.modules if m.startswith(("sparkloom.llm", "corpus_pipeline", "public_tokenizers"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert __spark_entry__.queries().keys() == reference.QUERIES.keys()
    assert __spark_entry__.oracle_sql() == reference.SQL


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 120"
    assert subprocess.run([sys.executable, "-c", code], cwd=here, check=False).returncode == 0
