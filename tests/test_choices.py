"""Near hashes, distinct images and community dedup against plain loops."""

import math
import random

import pytest

from recordloom.operators import communities as C
from recordloom.operators import hashes as H


def _flipped(rng, h, n):
    for b in rng.sample(range(64), n):
        h ^= 1 << b
    return h


@pytest.mark.parametrize("most", [0, 3, 5, 8, 12])
def test_near_pairs_equal_all_pairs(spark, most):
    rng = random.Random(most)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    rows = [(g, _flipped(rng, rng.choice(seeds), rng.randint(0, most // 2 + 2))) for g in (1, 2) for _ in range(60)]
    # the bits of a pair spread evenly over the bands, and all in one
    rows += [(3, 0), (3, sum(1 << (16 * (i % 4) + i) for i in range(most))), (3, (1 << most) - 1), (3, (1 << (most + 1)) - 1)] + [(4, 7)] * 50
    df = spark.createDataFrame([(g, f"{h:016x}") for g, h in rows] + [(1, None)], "group long, h string").repartition(3)
    got = sorted(map(tuple, H.near_pairs(df, most).collect()))
    hashes = sorted({(g, f"{h:016x}") for g, h in rows})
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == sorted((g, a, b, bits(a, b)) for g, a in hashes for k, b in hashes if g == k and a < b and bits(a, b) <= most)


@pytest.mark.parametrize("seed", [1, 2])
def test_images_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(120):
        h = None if rng.random() < 0.2 else f"{_flipped(rng, rng.choice(seeds), rng.randint(0, 6)):016x}"
        rows.append((rng.randint(1, 2), i, rng.randint(0, 40), None if rng.random() < 0.1 else f"http://p/{rng.randint(0, 60)}", h, rng.randint(0, 4)))
    df = spark.createDataFrame(rows, "group long, item long, rank long, url string, h string, publisher long").repartition(3)
    got = sorted(map(tuple, H.distinct_images(df, 9).collect()))
    want = []
    for group in (1, 2):
        urls, shown, lead, rest, first = set(), [], [], [], set()
        for _, item, _, url, h, publisher in sorted((r for r in rows if r[0] == group), key=lambda r: (r[2], r[1])):
            if url in urls or (h and any((int(h, 16) ^ int(x, 16)).bit_count() <= 8 for x in shown)):
                continue
            urls |= {url} - {None}
            shown += [h] if h else []
            (rest if publisher in first else lead).append(item)
            first.add(publisher)
        want += [(group, item, n) for n, item in enumerate((lead + rest)[:9], 1)]
    assert got == sorted(want)
    assert H.distinct_images(df.limit(0), 9).count() == 0


def _random_sets(rng, n):
    base = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(6)]
    out = {}
    for i in range(n):
        b = rng.choice(base)
        out[i] = set(rng.sample(b, rng.randint(1, len(b)))) | {99} | set(rng.sample(range(60), rng.randint(0, 6)))
    return out


@pytest.mark.parametrize("seed,share", [(1, 0.6), (2, 0.6), (3, 1.0), (4, 0.25)])
def test_contained_pairs_and_dedup_equal_brute_force(spark, seed, share):
    rng = random.Random(seed)
    sets = _random_sets(rng, 50)
    rows = [(i, m) for i, s in sets.items() for m in s] * 2
    df = spark.createDataFrame(rows, "set_id long, member long").repartition(3)
    overlap = lambda a, b: len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))
    want = {(a, b): round(overlap(a, b), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= math.ceil(share * min(len(sets[a]), len(sets[b])) - 1e-9)}
    assert {(r.a, r.b): r.overlap for r in C.contained_pairs(df, share).collect()} == want
    order = rng.sample(range(50), 50)
    facts = [(i, order[i], i % 5, len(s)) for i, s in sets.items()]
    got = {r.set_id: r.taken for r in C.deduplicated(spark.createDataFrame(facts, "set_id long, rank long, outlets long, members long"), df, share).collect()}
    covered, expected = [], {}
    for i in sorted((f[0] for f in facts if f[2] >= 2 and f[3] >= 2), key=lambda i: order[i]):
        expected[i] = not any((min(i, c), max(i, c)) in want for c in covered)
        covered += [i] if expected[i] else []
    assert got == expected


def test_a_member_of_all_sets_makes_no_pairs(spark):
    """The hub is in every set but in no prefix while rarer members are left."""
    rows = [(i, m) for i in range(300) for m in (-1, 10 * i, 10 * i + 1, 10 * i + 2)]
    assert C.contained_pairs(spark.createDataFrame(rows, "set_id long, member long")).count() == 0


@pytest.mark.parametrize("block", [7, 8192])
def test_all_near_pairs_equal_all_pairs(spark, block):
    """Blocks and strips of any size; null groups and hashes, copies and groups of one row."""
    rng = random.Random(block)
    rows = [(rng.choice(["x", "y", None]), i, f"{rng.getrandbits(64):016x}") for i in range(150)] + [("x", 900 + i, f"{(1 << 64) - 1:016x}") for i in range(3)] + [("x", 950, None), ("z", 951, "0" * 16)]
    df = spark.createDataFrame(rows, "group string, item long, h string").repartition(3)
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = sorted((a, b, bits(x, y)) for g, a, x in rows for k, b, y in rows if g and g == k and a < b and x and y and bits(x, y) <= 26)
    found = H.all_near_pairs(df, 26, block)
    assert sorted(map(tuple, found.collect())) == want
    assert H.all_near_pairs(df.limit(0), 26).count() == 0


def test_hamming_pairs_join_no_pairs(spark, tiny):
    """Pairs are made where blocks meet, never as rows of a join of a source with itself."""
    from recordloom.plans import texts

    plan = texts.hamming_pairs(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "hamming" not in plan and plan.count("Relation") == 2  # rows, and their count by source


def test_keys_of_near_pairs_are_not_broadcast(spark, tmp_path):
    """Sixty-eight keys a hash come out of a table that is small on disk."""
    spark.range(2000).selectExpr("id % 3 AS group", "substr(md5(string(id)), 1, 16) AS h").write.parquet(f"{tmp_path}/h")
    pairs = H.near_pairs(spark.read.parquet(f"{tmp_path}/h"))
    pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
