"""Passages and clips against plain loops."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.operators import clips as C

T0 = dt.datetime(2024, 1, 1)


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_clips_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    hits = []
    for event in range(6):
        for episode in range(4):
            for seq in sorted(rng.sample(range(40), 25)):
                start = seq * 18.0 + rng.randint(0, 5)
                hits.append((event, episode, seq, start, start + rng.randint(10, 40), rng.randint(0, 30) / 100))
    df = spark.createDataFrame(hits, "event_id long, episode long, seq long, start_s double, end_s double, score double").repartition(3)
    got = sorted(map(tuple, C.clips(df).collect()))
    want = []
    for event in range(6):
        made = []
        for episode in range(4):
            rows = sorted(h for h in hits if h[:2] == (event, episode))
            runs = []
            for h in rows:
                runs.append([h]) if not runs or h[2] != runs[-1][-1][2] + 1 else runs[-1].append(h)
            for run in runs:
                best = max(range(len(run)), key=lambda i: run[i][5])
                lo = hi = best
                grew = True
                while grew:
                    grew = False
                    if lo and run[hi][4] - run[lo - 1][3] <= 90:
                        lo, grew = lo - 1, True
                    if hi < len(run) - 1 and run[hi + 1][4] - run[lo][3] <= 90:
                        hi, grew = hi + 1, True
                made.append((event, episode, run[best][2], run[lo][3], run[hi][4], run[best][5]))
        made.sort(key=lambda c: (-c[5], c[1], c[2]))
        shown, used = [], set()
        for c in made:
            if c[1] not in used and len(shown) < 4:
                used.add(c[1])
                shown.append((*c, len(shown) + 1))
        want += shown
    assert got == sorted(want)
    assert C.clips(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,name,want", [
    ("the BJP won", "BJP", True), ("the bjp won", "BJP", False), ("the BJPs won", "BJP", False), ("it is so", "is", False), ("Rahul  Gandhi spoke", "rahul gandhi", True),
    ("Rahul-Gandhi spoke", "Rahul Gandhi", True), ("Rahulgandhi spoke", "Rahul Gandhi", False), ("ಸಿದ್ದರಾಮಯ್ಯ ಅವರು", "ಸಿದ್ದರಾಮಯ್ಯ", True), ("", "Asha Rao", False),
])
def test_names_are_whole_words(spark, text, name, want):
    assert _one(spark, C.names_it(F.lit(text), F.lit(name))) is want


def test_title_words_and_previews(spark):
    assert _one(spark, C.title_hits(F.lit("the Flood toll rises in Assam, floods"), F.lit("Assam flood toll rises: India government says"))) == 4
    assert _one(spark, C.title_hits(F.lit(""), F.lit("Assam flood"))) == 0
    told = [bool(re.search(C.PREVIEW, t)) for t in ("PM to inaugurate Semicon", "bill set for final vote", "PM inaugurates Semicon", "rain on Thursday")]
    assert told == [True, True, False, True]


def test_passages_are_placed(spark):
    """Address, band, time, preview gone by, magnet, rare cast, judge, one of each story."""
    hour = dt.timedelta(hours=1)
    v = [1.0, 0.0, 0.0]
    records = [
        (1, "Assam flood toll rises", T0, v), (2, "Flood relief in Assam grows", T0, [1.0, 0.02, 0.0]), (3, "Assam flood toll far away in time", T0 - 80 * hour, v), (4, "Minister to launch Assam flood toll fund", T0 - 30 * hour, v),
        (5, "nothing in common", T0, v), (6, "cast only", T0, [1.0, 0.05, 0.0]), (7, "linked", T0 - 900 * hour, [0.0, 0.0, 1.0]), (8, "Assam flood toll out of the band", T0, [0.8, 0.6, 0.0]),
    ]
    passages = [(100, T0, "The flood toll in Assam, said Hemanta Sarma", v, ["http://x/7", "http://x/none"]), (101, T0, "nothing of the kind", v, []), (102, T0, "Assam flood toll", None, []), (103, T0 + 500 * hour, "Assam flood toll", v, [])]
    cast = [(6, "Hemanta Sarma"), *[(e, "Everyone") for e in range(1, 9)]]
    frames = {
        "passages": spark.createDataFrame(passages, "passage_id long, at timestamp_ntz, text string, vector array<double>, urls array<string>"),
        "records": spark.createDataFrame(records, "event_id long, title string, at timestamp_ntz, vector array<double>"),
        "addresses": spark.createDataFrame([(7, "http://x/7"), (7, "http://x/7")], "event_id long, url string"),
        "cast": spark.createDataFrame(cast, "event_id long, name string"), "stories": spark.createDataFrame([(1, 50), (2, 50)], "event_id long, story long"),
    }
    yes = lambda asked: asked.withColumn("ok", F.lit(True))
    got = C.placed(**frames, judge=yes, min_cos=0.7, common=0.2)
    assert sorted(tuple(r) for r in got.collect()) == [(100, 1, 50, 1.0, "judge"), (100, 6, 6, 0.998752, "judge"), (100, 7, 7, 1.0, "url")]
    no = lambda asked: asked.withColumn("ok", F.lit(False))
    assert [tuple(r) for r in C.placed(**frames, judge=no, min_cos=0.7, common=0.2).collect()] == [(100, 7, 7, 1.0, "url")]
    # records 1 and 2, 5 and 6 are three stories in the band: a magnet
    assert [r.method for r in C.placed(**frames, judge=yes, min_cos=0.7, common=0.2, magnet=2).collect()] == ["url"]
