"""Table functions and the aggregate, called from SQL."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from recordloom.functions import tables

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return spark.sql


def test_sessions(spark, sql):
    at = [0, 10, 130, 131, 300]
    rows = [(k, T0 + dt.timedelta(seconds=s)) for k in ("a", "b") for s in (at if k == "a" else at[:1])] + [("a", None), ("c", None), (None, T0), (None, T0)]
    spark.createDataFrame(rows, "who string, seen timestamp_ntz").repartition(3).createOrReplaceTempView("visits")
    got = sql("SELECT * FROM sessions(TABLE(visits) PARTITION BY who ORDER BY (seen), gap_seconds => 120)")
    assert got.columns == ["who", "session", "started", "ended", "n"] and dict(got.dtypes)["who"] == "string"
    s = lambda x: T0 + dt.timedelta(seconds=x)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 1, s(0), s(131), 4), ("a", 2, s(300), s(300), 1), ("b", 1, s(0), s(0), 1), (None, 1, s(0), s(0), 2)], key=repr)
    assert sql("SELECT * FROM sessions(TABLE(SELECT * FROM visits WHERE who = 'z') PARTITION BY who ORDER BY (seen), gap_seconds => 1)").count() == 0


def test_chunks_in_a_lateral_join(spark, sql):
    spark.createDataFrame([(1, "word " * 100), (2, ""), (3, None)], "id long, text string").createOrReplaceTempView("texts")
    got = sql("SELECT id, c.chunk_index, c.chunk FROM texts, LATERAL text_chunks(text, size => 120, overlap => 20) c").collect()
    assert {r.id for r in got} == {1} and all(len(r.chunk) <= 120 for r in got) and [r.chunk_index for r in got] == list(range(len(got))) and len(got) > 4


@pytest.mark.parametrize("call", [
    "SELECT * FROM text_chunks(5)", "SELECT * FROM text_chunks('x', size => -1)",
    "SELECT * FROM sessions(TABLE(SELECT 1 AS a, 2 AS b) PARTITION BY a ORDER BY (b), gap_seconds => 1)", "SELECT * FROM sessions(TABLE(SELECT 1 AS a, current_timestamp() AS b) PARTITION BY a ORDER BY (b), gap_seconds => -1)",
])
def test_wrong_calls_are_refused_before_they_run(sql, call):
    with pytest.raises(AnalysisException):
        sql(call).collect()


def test_trimmed_mean(spark, sql):
    rows = [("a", float(x)) for x in (1000, 1, 2, 3, 4, 5, 6, 7, 8, -1000)] + [("b", 4.0), ("b", None), ("c", None)]
    spark.createDataFrame(rows, "k string, v double").createOrReplaceTempView("measures")
    assert {r.k: r.m for r in sql("SELECT k, trimmed_mean(v) AS m FROM measures GROUP BY k").collect()} == {"a": 4.5, "b": 4.0, "c": None}
