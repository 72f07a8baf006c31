"""Stories that persist, on small vectors."""

import datetime as dt
import random

from pyspark.sql import functions as F

from recordloom.operators import assignment as A

DAY, T0 = dt.timedelta(days=1), dt.datetime(2024, 1, 1)


def _records(spark, rows):
    return spark.createDataFrame(rows, "event_id long, at timestamp_ntz, vector array<double>")


def _stories(spark, tmp_path, running=(), score=0.9, **options):
    scopes = spark.createDataFrame([(r,) for r in running], "story long")
    return A.Assignments(spark, f"file://{tmp_path}/s", scopes, lambda asked: asked.withColumn("score", score if not isinstance(score, float) else F.lit(score)), **options)


def _placed(df):
    return {r.event_id: (r.story, r.how) for r in df.collect()}


def test_batches_join_and_found(spark, tmp_path):
    s = _stories(spark, tmp_path)
    none = spark.createDataFrame([], "a long, b long")
    assert _placed(s.run(0, _records(spark, [(1, T0, [1.0, 0.0]), (2, T0, [0.0, 1.0]), (3, T0, None)]), none)) == {i: (i, "founded") for i in (1, 2, 3)}
    batch = [(10, T0 + DAY, [1.0, 0.1]), (11, T0 + 20 * DAY, [1.0, 0.1]), (12, T0 + DAY, None), (13, T0 - DAY, [0.0, 1.0]), (14, T0 - dt.timedelta(minutes=30), [0.0, 1.0]), (1, T0, [1.0, 0.0]), (10, T0 + DAY, [1.0, 0.1])]
    links = spark.createDataFrame([(12, 2), (99, 1)], "a long, b long")
    want = {10: (1, "joined"), 11: (11, "founded"), 12: (2, "joined"), 13: (13, "founded"), 14: (2, "joined")}
    assert _placed(s.run(1, _records(spark, batch), links)) == want
    # a batch that runs again replaces its own answers
    assert _placed(s.run(1, _records(spark, batch), links)) == want and s.placed(2).count() == 8
    assert s.run(2, _records(spark, []), none).count() == 0


def test_floors_and_the_established_story(spark, tmp_path):
    s = _stories(spark, tmp_path, running=[3], score=F.when(F.col("story") == 3, 0.65).when(F.col("event_id") == 30, 0.69).otherwise(0.75), farthest=0.5)
    none = spark.createDataFrame([], "a long, b long")
    s.run(0, _records(spark, [(1, T0, [1.0, 0.0]), (2, T0 + DAY, [1.0, 0.05]), (3, T0 - 40 * DAY, [0.0, 1.0])]), none)
    s.run(1, _records(spark, [(20, T0 + DAY, [1.0, 0.02])]), none)
    got = _placed(s.placed(2))
    assert got[20] == (1, "joined")  # as near a judge's score, but the older story
    links = spark.createDataFrame([(31, 3)], "a long, b long")
    got = _placed(s.run(2, _records(spark, [(30, T0 + DAY, [1.0, 0.05]), (31, T0 + DAY, [1.0, 0.05]), (32, T0 + DAY, [1.0, 0.05])]), links))
    assert got == {30: (30, "founded"), 31: (3, "joined"), 32: (1, "joined")}  # under the floor; a running story first; the larger story


def test_near_stories_equal_brute_force(spark):
    rng = random.Random(4)
    hour = 3_600_000_000
    vec = lambda: [rng.gauss(0, 1) for _ in range(3)]
    held = [(rng.randrange(12), rng.randrange(-900, 900) * hour, vec()) for _ in range(200)]
    asks = [(i, rng.randrange(-900, 900) * hour, vec()) for i in range(60)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for after in (hour, None):
        got = A.near_stories(spark.createDataFrame(asks, "event_id long, at long, vector array<double>"), spark.createDataFrame(held, "story long, at long, vector array<double>"), 3, 0.3, after, block=64)
        want = set()
        for i, now, v in asks:
            least = {}
            for s, at, w in held:
                d = round(1 - round(cos(v, w), 6), 6)
                if d <= 0.3 and now - 14 * 24 * hour <= at and (after is None or at <= now + after):
                    least[s] = min(least.get(s, d), d)
            want |= {(i, s, d) for d, s in sorted((d, s) for s, d in least.items())[:3]}
        assert {tuple(r) for r in got.collect()} == want
