"""Work that grows with the input: rows made, blocks and memory of the steps that once grew faster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import assignment as A
from recordloom.operators import blocks as B
from recordloom.operators import communities as C
from recordloom.operators import sparse
from recordloom.operators import stories as S
from recordloom.operators import vectors as V
from recordloom.plans import evaluation


def most_rows(df):
    """The most rows that any step of ``df`` made."""
    df.collect()
    steps, most = [df._jdf.queryExecution().executedPlan()], 0
    while steps:
        step = steps.pop()
        kind = step.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            steps.append(step.executedPlan())
        elif kind.endswith("QueryStageExec"):
            steps.append(step.plan())
        made = step.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        steps += [step.children().apply(i) for i in range(step.children().size())]
    return most


def test_gold_pairs_are_counted_not_made(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0 if i % 2 else None) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = evaluation.candidate_recall(spark, str(tmp_path))
    assert most_rows(df) <= 21 * 600
    assert sum(r.gold for r in df.collect()) == 300 * 299


@pytest.mark.parametrize("floor", [None, 0.3])
def test_tops_equal_brute_force_with_ties(floor):
    rng = np.random.default_rng(2)
    y = V._unit(np.repeat(rng.normal(size=(300, 6)), 3, axis=0))
    ids = rng.permutation(900)
    parts = list(V._tops(ids, y, ids, y, 5, floor, True, 6))
    got = list(zip(*(np.concatenate(p).tolist() for p in zip(*parts, strict=True)), strict=True))
    sims, want = np.round(y @ y.T, 6) + 0.0, []
    for i in range(900):
        found = sorted((-sims[i, j], ids[j]) for j in range(900) if j != i and (floor is None or sims[i, j] >= floor))
        want += [(ids[i], j, -s) for s, j in found[:5]]
    assert sorted((a, b) for a, b, _ in got) == sorted((a, b) for a, b, _ in want)
    assert np.allclose(sorted(s for *_, s in got), sorted(s for *_, s in want))


def test_vectors_are_dealt_to_fewer_blocks_than_they_grow():
    sizes = (0, 4096, 10_256, 102_564, 615_384)
    assert [V._blocks(n, 4096, 2) for n in sizes] == [1, 1, 3, 13, 76]
    assert [V._blocks(n, 4096, 8) for n in sizes] == [1, 1, 3, 12, 19]


@pytest.mark.parametrize("floor", [None, 0.4])
def test_lists_of_neighbours_grow_with_rows_not_with_blocks(spark, floor):
    rng = np.random.default_rng(4)
    x = np.round(np.repeat(rng.normal(size=(300, 6)), 2, axis=0), 3)
    ids = rng.permutation(600)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    near = V.nearest(df, 30, floor=floor, block=8, digits=6)
    assert most_rows(near) <= 2 * 30 * 600
    unit, want = V._unit(x), set()
    sims = np.round(np.einsum("id,jd->ij", unit, unit), 6) + 0.0
    for i in range(600):
        found = sorted((-sims[i, j], int(ids[j])) for j in range(600) if j != i and (floor is None or sims[i, j] >= floor))
        want |= {(int(ids[i]), j, n) for n, (_, j) in enumerate(found[:30], 1)}
    assert {(r.vec_id, r.nbr_id, r.rnk) for r in near.collect()} == want


def test_few_asking_rows_keep_all_cores_at_work():
    assert [V._dealt(n, m, 4096) for n, m in ((615_384, 615_384), (102_564, 102_564), (1_000, 615_384), (2_000, 2_000), (0, 5))] == [(38, 1), (12, 2), (1, 19), (1, 1), (1, 1)]


@pytest.mark.parametrize("both_ways", [False, True])
def test_shared_actors_travel_as_lists(spark, both_ways):
    """Lists of records are shuffled, pairs are not; hubs' lists are dealt into several."""
    rows = [(e, a) for a in range(30) for e in range(a, a + 60)] + [(e, 100) for e in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "event_id long, entity_id long")
    want = {}
    names = {e: {a for x, a in rows if x == e} for e, _ in rows}
    for a in names:
        for b in names:
            if a < b and names[a] & names[b]:
                want[a, b] = len(names[a] & names[b])
    for hub_df in (4, 256):
        got = S.shared_actors(df, F.col("shared") >= 1, 1, 0.0, hub_df=hub_df, both_ways=both_ways).select("a", "b", "shared")
        assert {(r.a, r.b): r.shared for r in got.collect()} == want | ({(b, a): n for (a, b), n in want.items()} if both_ways else {})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "REPARTITION_BY_NUM" in plan and "hashpartitioning(a#" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(a#" in x and ", b#" in x]


def test_related_records_are_cut_before_they_meet_others(spark):
    rows = [(e, a) for a in range(20) for e in range(60)]
    df = spark.createDataFrame(rows, "event_id long, entity_id long")
    got = S.related(df.select("event_id").distinct(), df, 0.01, 5)
    assert got.count() == 300 and got.where("event_id = 0 AND rnk = 1").first().other_id == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan.split("Window [row_number")[0] and "Exchange hashpartitioning(event_id" not in plan.split("Window [row_number")[1].split("REPARTITION_BY_NUM")[0]


def casts_of(seed, records, actors, each):
    rng = np.random.default_rng(seed)
    return sorted({(e, int(a)) for e in range(records) for a in rng.choice(actors, each, replace=False)})


def shared_by_all(rows):
    """(a, b): the weights of what two records share, both ways, and the records of each actor."""
    held, found = {}, {}
    for e, a in sorted(set(rows), key=str):
        if a is not None:
            held.setdefault(a, []).append(e)
    for es in held.values():
        for x in es:
            for y in es:
                if x != y and None not in (x, y):
                    found.setdefault((x, y), []).append(1 / len(es))
    return found


@pytest.mark.parametrize("both_ways", [False, True])
@pytest.mark.parametrize("hub_df", [256, 2])
def test_pairs_that_share_one_actor_are_not_made_where_two_are_asked(spark, hub_df, both_ways):
    rows = casts_of(5, 2000, 120, 3)
    got = S.shared_actors(spark.createDataFrame(rows, "event_id long, entity_id long"), F.col("shared") >= 2, 2, hub_df=hub_df, both_ways=both_ways)
    found = shared_by_all(rows)
    assert len(found) > 200_000 and most_rows(got) < 40_000
    want = {p: (len(w), round(sum(w), 9), round(max(w), 9)) for p, w in found.items() if len(w) >= 2 and (both_ways or p[0] < p[1])}
    rows = got.collect()
    assert {(r.a, r.b): (r.shared, round(r.weight, 9), round(r.rarest, 9)) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize(("records", "actors", "each", "floor", "k"), [(2000, 120, 3, 0.01, 5), (300, 200, 4, 0.3, 3), (300, 200, 4, 0.0, 1), (60, 8, 5, 0.01, 4), (200, 90, 1, 0.0, 5)])
def test_related_records_equal_all_pairs_and_are_not_made_of_them(spark, records, actors, each, floor, k):
    rows = casts_of(6, records, actors, each) + [(e, 10_000 + a) for e in (3, 7, 11) for a in range(3)]
    rows += [(None, a) for a in range(actors)] + [(e, None) for e in range(50)] + [(1000 + e, 20_000 + n) for n in (k, k + 1) for e in range(n)] + [(None, 20_000 + k), (None, 20_001 + k)]
    rows += [(1000 + e, 30_000) for e in range(2 * k + 4)]
    df = spark.createDataFrame(rows, "event_id long, entity_id long")
    got = S.related(df.select("event_id").where("event_id % 5 < 4"), df, floor, k)
    best, want = {}, set()
    for (x, y), w in shared_by_all(rows).items():
        best.setdefault(x, []).append((-round(sum(w), 6), y))
    for x, ys in best.items():
        want |= {(x, y, -w, n) for n, (w, y) in enumerate(sorted(p for p in ys if -p[0] >= floor)[:k], 1) if x % 5 < 4}
    if records == 2000:
        assert most_rows(got) < 60_000
    assert {(r.event_id, r.other_id, r.weight, r.rnk) for r in got.collect()} == want


@pytest.mark.parametrize("after", [None, 50])
def test_asks_of_one_time_are_dealt_too(spark, after):
    rng = np.random.default_rng(3)
    vector = lambda: [float(x) for x in rng.normal(size=4)]
    asks = [(i, int(rng.integers(0, 100)), vector()) for i in range(90)]
    held = [(i, int(rng.integers(0, 100)), vector()) for i in range(70)]
    df = spark.createDataFrame(asks, "event_id long, at long, vector array<double>")
    near = A.near_stories(df, spark.createDataFrame(held, "story long, at long, vector array<double>"), 2, 2.0, after, block=16, before=100)
    x, y = (V._unit(np.array([r[2] for r in side])) for side in (asks, held))
    far, want = np.round(1.0 - np.round(x @ y.T, 6), 6) + 0.0, set()
    for i, (event, at, _) in enumerate(asks):
        ok = [(far[i, j], held[j][0]) for j in range(70) if held[j][1] >= at - 100 and (after is None or held[j][1] <= at + after)]
        want |= {(event, story, d) for d, story in sorted(ok)[:2]}
    assert {(r.event_id, r.story, r.d) for r in near.collect()} == want
    assert "FlatMapGroupsInArrow [bucket" in (plan := near._jdf.queryExecution().executedPlan().toString()) and "part#" in plan


def test_trimmed_mean_of_many_groups_calls_no_python(spark, tiny):
    plan = evaluation.sql_trimmed_mean(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    values = [1000.0, None, 1.0, 2.0, 3.0, float("nan"), 4.0, 5.0, 6.0, 7.0, 8.0, -1000.0]
    rows = [("a", values), ("b", [4.0]), ("c", [None]), ("d", [])]
    spark.createDataFrame(rows, "k string, v array<double>").createOrReplaceTempView("measured")
    assert {r.k: r.m for r in spark.sql("SELECT k, trimmed_mean_of(v) AS m FROM measured").collect()} == {"a": 4.5, "b": 4.0, "c": None, "d": None}


def test_scripts_are_counted_by_runs(spark):
    texts = ["plain latin", "", None, "123 ...", "\u0995\u0996 a", "\u0915\u0C95 x", "\u0627\u0628\u0627 latin letters", "abc \u0915\u0916\u0917\u0918"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.script_of(F.col("t")).alias("s"), T.is_latin(F.col("t")).alias("l"))
    assert [tuple(r)[1:] for r in df.collect()] == [
        ("latin", True), ("latin", False), ("latin", None), ("latin", False), ("bengali", False), ("kannada", False), ("arabic", True), ("devanagari", False),
    ]
    assert "[^" not in df._jdf.queryExecution().executedPlan().toString()
    assert min(min(block.encode().decode("unicode_escape").replace("-", "")) for block in T.SCRIPTS.values()) >= "\u0600"


@pytest.mark.parametrize(("hub", "share"), [(64, 0.6), (3, 0.6), (12, 0.3), (1, 1.0)])
def test_containing_sets_travel_as_lists_and_frequent_members_make_none(spark, monkeypatch, hub, share):
    """Lists of sets are shuffled, pairs are not; members of more than HUB sets are in no list and still count."""
    monkeypatch.setattr(C, "HUB", hub)
    rng = np.random.default_rng(7)
    sets = {i: {int(m) for m in rng.choice(60, rng.integers(1, 9), replace=False) ** 2 // 60} for i in range(150)}
    sets |= {150 + i: set(sets[i]) | {100 + i} for i in range(20)}
    df = spark.createDataFrame([(i, m) for i, s in sets.items() for m in s] * 2 + [(None, 1), (3, None)], "set_id long, member long").repartition(3)
    want = {}
    for a in sets:
        for b in sets:
            least = min(len(sets[a]), len(sets[b]))
            if a < b and len(sets[a] & sets[b]) >= share * least - 1e-9:
                want[a, b] = round(len(sets[a] & sets[b]) / least, 6)
    rows = C.contained_pairs(df, share).collect()
    assert {(r.a, r.b): r.overlap for r in rows} == want and len(rows) == len(want)
    monkeypatch.setattr(C, "HUB", 1000)
    plan = C.contained_pairs(df, share)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(s#" in x and ", ns#" in x]


@pytest.mark.parametrize("size", [5, 14])
def test_names_of_many_casts_make_no_pairs_where_several_are_asked(spark, size):
    """Casts that must share four of five names meet on two: one name shared is no pair. Larger ones meet on one."""
    rng = np.random.default_rng(8)
    casts = {i: [int(n) for n in rng.choice(40, 5 if i < 590 else size, replace=False)] for i in range(600)}
    weight = {n: 1 / (29 + n % 4) for n in range(40)}
    df = spark.createDataFrame([(i, n, weight[n]) for i, c in casts.items() for n in c], "set_id long, name long, weight double")
    both = {(a, b): set(casts[a]) & set(casts[b]) for a in casts for b in casts if a < b}
    got = C.weighted_pairs(df, 0.12)
    want = {p: round(sum(weight[n] for n in s), 9) for p, s in both.items() if sum(weight[n] for n in s) >= 0.12}
    rows = got.collect()
    assert {(r.a, r.b): round(r.weight, 6) for r in rows} == {p: round(w, 6) for p, w in want.items()} and len(rows) == len(want)
    alike = sparse.jaccard_pairs(df.select(F.lit(0).alias("group"), F.col("set_id").alias("id"), F.col("name").alias("term")), 0.5)
    assert {(r.a, r.b) for r in alike.collect()} == {p for p, s in both.items() if 2 * len(s) >= len(set(casts[p[0]]) | set(casts[p[1]]))}
    if size == 5:
        assert most_rows(got) < 8_000 < len([p for p, s in both.items() if s]) and most_rows(alike) < 8_000



@pytest.mark.parametrize(("block", "cells", "floor"), [(32_768, 4_000_000, 0.6), (16, 100, 0.6), (16, 100, 0.2), (7, 1, 1.0)])
def test_sets_of_common_terms_meet_in_blocks(spark, monkeypatch, block, cells, floor):
    """Rows travel to blocks; no step makes a pair that is not alike enough, and copies meet nothing."""
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "ENTRIES", cells)
    monkeypatch.setattr(B.alike, "__defaults__", (block,))
    rng = np.random.default_rng(9)
    odds = np.array([0.9] * 8 + [0.05] * 60)
    sets = {i: set(np.flatnonzero(rng.random(68) < odds * rng.choice([0.6, 1.0])).tolist()) for i in range(120)} | {120: set(), 121: {70}, 122: {70}}
    sets |= {130 + i: set(sets[i % 3]) for i in range(12)}
    groups = {i: [i % 4, i % 4 + 1] if i % 7 else [None] for i in sets}
    df = spark.createDataFrame([(groups[i], i, list(s)) for i, s in sets.items()], "groups array<long>, id long, s array<long>").repartition(3)
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (either := sets[a] | sets[b]) and len(sets[a] & sets[b]) >= floor * len(either) - 1e-9:
                want |= {(g, a, b): (len(sets[a] & sets[b]), len(either)) for g in set(groups[a]) & set(groups[b]) - {None}}
    rows = (got := sparse.alike_sets(df, floor)).collect()
    assert {(r.group, r.a, r.b): (r.shared, r.either) for r in rows} == want and len(rows) == len(want)
    assert most_rows(got) <= max(len(want), 2 * len(sets))


@pytest.mark.parametrize(("block", "cells", "floor"), [(32_768, 4_000_000, 0.39), (16, 100, 0.39), (7, 1, 0.05)])
def test_headlines_meet_in_blocks(spark, monkeypatch, block, cells, floor):
    """Neither vectors nor pairs of representatives that are not alike enough are rows of any step."""
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "ENTRIES", cells)
    monkeypatch.setattr(B.alike, "__defaults__", (block,))
    rng = np.random.default_rng(10)
    odds = np.array([0.8] * 5 + [0.04] * 80)
    rows = {i: {int(t): float(rng.choice([0.2, 1.0, 3.0])) for t in np.flatnonzero(rng.random(85) < odds)} or {99: 1.0} for i in range(140)}
    rows |= {200 + i: dict(rows[i % 2]) for i in range(9)}
    df = spark.createDataFrame([("g" if i % 3 else "h", i, str(t), x) for i, v in rows.items() for t, x in v.items()], "group string, id long, term string, x double").repartition(3)
    norm = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in rows.items()}
    cos = {(a, b): sum(x * rows[b].get(t, 0) for t, x in rows[a].items()) / norm[a] / norm[b] for a in rows for b in rows if a < b and bool(a % 3) == bool(b % 3)}
    got = sparse.cosine_pairs(df, floor)
    found = got.collect()
    assert {(r.a, r.b): round(r.score, 9) for r in found} == {p: round(c, 9) for p, c in cos.items() if c >= floor} and len(found) == len({(r.a, r.b) for r in found})
    members, pairs = sparse.cosine_classes(df, floor)
    reps = {r.rep for r in members.collect()}
    assert len(reps) == len({(bool(i % 3), *sorted(v.items())) for i, v in rows.items()}) < len(rows) and pairs.count() == len([p for p, c in cos.items() if c >= floor and set(p) <= reps])
