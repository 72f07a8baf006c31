"""Every query against its SQL twin: columns, types and values."""

import duckdb
import pytest

from recordloom.plans import analytics, choices, entities, evaluation, feed, passages, relational, stories, streams, texts  # noqa: F401 - they register their queries
from recordloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.fixture(scope="session")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_twin(name, spark, tiny, duck):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert len(set(columns)) == len(columns)
    if name not in ORACLES:
        return
    twin = duck.sql(ORACLES[name])
    at = [twin.columns.index(c) for c in columns]
    kinds = dict(df.dtypes)
    assert {c: TYPES[kinds[c]] for c in columns} == {c: str(twin.types[i]) for c, i in zip(columns, at, strict=True)}
    assert len(twin.columns) == len(columns)
    assert rows == sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=repr)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
