"""Strings in texts against plain search."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.functions import text as T
from recordloom.operators import search


@given(st.text(alphabet="abé😀 ", max_size=300), st.integers(0, 200), st.integers(1, 200))
@settings(max_examples=300, deadline=None)
def test_a_texts_sample_has_every_strings_anchor(text, at, n):
    string = text[at : at + n]
    if not string:
        return
    c = max(c for c in search.GRAMS if c <= len(string))
    hashes = search.gram_hashes(string[:c], [search.GRAMS[c]])[search.GRAMS[c]]
    place = int(search.least_places(hashes, c - search.GRAMS[c] + 1)[0])
    sampled = {int(p): int(h) for k, places, found in search.anchors(text, [c]) for p, h in zip(places, found, strict=True)}
    assert sampled[at + place] == int(hashes.view("<i8")[place])


@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_least_places(values, run):
    import numpy as np

    got = search.least_places(np.array(values, np.uint64), run).tolist()
    assert got == [min(range(i, i + run), key=lambda j: (values[j], j)) for i in range(len(values) - run + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_found_equals_contains(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, "another text of id five " + texts[6]), (None, texts[7]), (90, None), (91, ""), (92, "a" * 3000), (93, "ab" * 1500)]
    strings = [(n, t[a : a + length]) for n, (t, a, length) in enumerate((rng.choice(texts), rng.randint(0, 200), rng.choice([1, 2, 3, 5, 9, 15, 16, 31, 50, 64, 127, 128, 200, 400])) for _ in range(120))]
    strings += [(900, ""), (901, None), (902, "a" * 130), (903, "never there"), (904, "ab" * 70), (904, "ab" * 70), (None, "漢")]
    got = search.occurrences(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(strings, "item_id long, q string").repartition(2))
    want = {(n, i, t.find(q) + 1, t.find(q) + len(q)) for n, q in strings for i, t in docs if q and t and q in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_nothing_to_find(spark):
    docs, strings = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "x")], "item_id long, q string")
    assert search.occurrences(docs.limit(0), strings).count() == search.occurrences(docs, strings.limit(0)).count() == 0


def test_only_sampled_places_travel():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(5000))
    rows = {c: len(places) for c, places, _ in search.anchors(text, [16, 64, 128])}
    assert rows[16] < 0.3 * len(text) and rows[64] < 0.06 * len(text) and rows[128] < 0.03 * len(text)


def test_spans_are_repaired(spark):
    docs = spark.createDataFrame([(1, "He said  that\nall of it is true and more."), (2, None)], "doc_id long, text string")
    claims = [(1, 1, "A", "that all   of it is true and"), (2, 1, "", "that all of it is true and"), (3, 1, "A", "too short"), (4, 1, None, "x"), (5, 1, "A", "that all of it is false and no more"), (6, 2, "A", "that all of it is true and"), (7, 3, "A", "no such document at all, none")]
    got = search.repaired_spans(spark.createDataFrame(claims, "claim_id long, doc_id long, speaker string, quote string"), docs, T.flat_ws)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "kept", 9, 34), (2, 1, "no_speaker", None, None), (3, 1, "short_quote", None, None), (4, 1, "no_speaker", None, None), (5, 1, "not_verbatim", None, None), (6, 2, "not_verbatim", None, None)]


def test_only_asked_places_travel(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(4000)) for _ in range(20)] + ["ab" * 2000]
    strings = [(n, texts[n][900 : 900 + length]) for n, length in enumerate([5, 14, 15, 16, 40, 200, 700, 3000])] + [(90, "abab"), (91, "ab" * 200)]
    asked = spark.createDataFrame(strings, "item_id long, q string").mapInArrow(search._anchored, "item_id long, q string, class int, at int, hash long")
    classes, bits = tuple(sorted({search.string_class(len(q)) for _, q in strings})), search.asked_bits(asked)
    found = [list(search.found_pieces(t, classes, bits)) for t in texts]
    assert all(found[n] for n in range(8)) and sum(map(len, found)) < 60
    got = search.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(strings, "item_id long, q string"))
    assert {tuple(r) for r in got.collect()} == {(n, i, t.find(q) + 1, t.find(q) + len(q)) for n, q in strings for i, t in enumerate(texts) if q in t}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "text#" in x]


def test_strings_of_one_item_are_found_apart(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    strings = spark.createDataFrame([(7, "two"), (7, "one"), (7, "one two three"), (7, "four")], "item_id long, q string")
    assert sorted(tuple(r) for r in search.occurrences(docs, strings).collect()) == [(7, 1, 1, 3), (7, 1, 1, 13), (7, 1, 5, 7)]


def test_a_full_bitmap_loses_nothing():
    text, bits = "some words that a text has", search.np.full(1 << 15, 255, search.np.uint8)
    assert len(list(search.found_pieces(text, [5], bits))) == len({text[i : i + 5] for i in range(len(text) - 4)})
