"""Fill-in-the-middle against plain lists of units."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import middle
from recordloom.llm.queries import ORACLES, QUERIES


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _slow(doc, text, rate=50, first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.text(alphabet="ab é漢\t\n\x0b\x1c\x85 😀<PSM>", max_size=60), st.integers(1, 5), st.integers(1, 9))
@settings(max_examples=400, deadline=None)
def test_checkpoints_equal_lists_of_units(text, step, block):
    units = UNIT.findall(text)
    index = middle.Checkpoints(text.encode(), step, block)
    assert index.n == len(units) and len(index.units) == 1 + len(units) // step
    for n in range(len(units) + 1):
        before = "".join(units[:n])
        assert index.end_of(n) == (len(before.encode()), len(before))


def test_cuts_equal_brute_force_on_odd_rows(spark):
    words = "the old mill by the river  and\nthe children "
    rows = [(i, words * (i % 5 + 1)) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "has <P> in it"), (64, "<S>"), (65, "x" * 300_000), (66, " " * 300_000), (67, words * 9000), (None, words), (None, None), (5, words), (5, words)]
    rows += [(i, "P>tail <" * 3 + "<<P <S") for i in range(70, 110)] + [(i, "漢字 😀é " * 40) for i in range(110, 140)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, form string, output string").repartition(3)
    made = middle.transformed(df)
    got = made.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((_slow(i, t) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.back) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert middle.transformed(df.limit(0)).count() == 0


@pytest.mark.parametrize("rate,first", [(0, 80), (100, 0), (100, 100)])
def test_other_recipes(spark, rate, first):
    rows = [(i, f"one two three {i}") for i in range(30)]
    got = middle.transformed(spark.createDataFrame(rows, "doc_id long, text string"), middle.Recipe(rate=rate, suffix_first=first)).collect()
    assert sorted(map(tuple, got)) == sorted(_slow(i, t, rate, first) for i, t in rows)


def test_own_marks(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    df = spark.createDataFrame([(i, f"one two <P> three {i}") for i in range(40)], "doc_id long, text string")
    made = middle.transformed(df, middle.Recipe(rate=100, marks=marks)).withColumn("back", middle.restored(F.col("output"), F.col("form"), marks))
    assert sorted((r.doc_id, r.back) for r in made.collect()) == [(i, f"one two <P> three {i}") for i in range(40)]


def test_equals_its_twin(spark, tiny):
    df = QUERIES["op13_fill_in_middle"](spark, tiny)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    twin = c.sql(ORACLES["op13_fill_in_middle"])
    assert df.columns == twin.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(twin.fetchall())
