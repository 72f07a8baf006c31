"""Greedy choice, variants under bans, and identifiers against plain loops."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import choice
from recordloom.operators import entities as E
from recordloom.plans import entities as _plans  # noqa: F401 - registers its queries
from recordloom.plans.registry import QUERIES


def _greedy(claims):
    rank = {i: r for i, _, r in claims}
    cells = collections.defaultdict(set)
    for i, c, _ in claims:
        if c is not None:
            cells[i].add(c)
    taken, out = set(), {}
    for i in sorted(cells, key=rank.get):
        out[i] = not cells[i] & taken
        if out[i]:
            taken |= cells[i]
    return out


@pytest.mark.parametrize("seed,items,cells,most", [(1, 40, 25, 3), (2, 60, 10, 2), (3, 30, 200, 6), (4, 50, 1, 1)])
def test_choice_equals_one_after_another(spark, seed, items, cells, most):
    rng = random.Random(seed)
    order = rng.sample(range(items), items)
    claims = [(i, rng.randrange(cells), order[i]) for i in range(items) for _ in range(rng.randint(1, most))]
    claims += [(items + 1, None, items + 1)]
    df = spark.createDataFrame(claims, "item long, cell long, rank long").repartition(3)
    got = {r.item: r.taken for r in choice.first_come(df, "item", "cell", "rank").collect()}
    assert got == _greedy(claims)
    assert choice.first_come(df.limit(0), "item", "cell", "rank").count() == 0


def test_a_chain_is_decided_link_by_link(spark):
    claims = [(i, c, i) for i in range(9) for c in (i, i + 1)]
    got = choice.first_come(spark.createDataFrame(claims, "item long, cell long, rank long"), "item", "cell", "rank")
    assert {r.item for r in got.where("taken").collect()} == {0, 2, 4, 6, 8}


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    slugs = ["narendra-bada", "narendrabada", "narendra-bede", "narendrra-bada", "narendra-koko", "asha-rao", "asharao", "ab-cd"]
    names = [(i, rng.choice(["person", "person", "organisation"]), rng.choice(slugs), rng.randint(1, 4)) for i in range(40)]
    records = [(rng.randrange(40), rng.randrange(30)) for _ in range(60)]
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(8)]
    stories = [(e, e // 5) for e in range(30)]
    reports = [(rng.randrange(40), rng.randrange(25)) for _ in range(70)]
    got = E.paired_variants(
        spark.createDataFrame(names, "entity_id long, kind string, slug string, mentions long"), spark.createDataFrame(records, "entity_id long, event_id long"),
        spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(stories, "event_id long, story long"), spark.createDataFrame(reports, "entity_id long, report_id long"),
    )
    folds = {"narendra": "nrndr", "narendrra": "nrndr", "bada": "bd", "bede": "bd", "koko": "kk", "asha": "s", "rao": "r", "ab": "b", "cd": "cd"}
    keys = {}
    for i, kind, slug, _ in names:
        skeleton = " ".join(folds[w] for w in slug.split("-")) if "-" in slug else ""
        keys[i] = {(kind, "r", slug.replace("-", ""))} | ({(kind, "s", skeleton)} if skeleton and len(skeleton.replace(" ", "")) >= 5 else set())
    parent = {i: i for i in keys}
    for a in keys:
        for b in keys:
            if keys[a] & keys[b]:
                parent[_find(parent, a)] = _find(parent, b)
    mentions = {i: m for i, _, _, m in names}
    events, used, story = collections.defaultdict(set), collections.defaultdict(set), dict(stories)
    for i, e in records:
        events[i].add(e)
    for i, r in reports:
        used[i].add(r)
    either = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    want, groups = {}, collections.defaultdict(list)
    for i in keys:
        groups[_find(parent, i)].append(i)
    for group in groups.values():
        survivor = min(group, key=lambda i: (-mentions[i], i))
        asked = []
        for v in set(group) - {survivor}:
            tier = next((n for n, ok in enumerate((
                events[v] & events[survivor], any((a, b) in either for a in events[v] for b in events[survivor]),
                {story[e] for e in events[v]} & {story[e] for e in events[survivor]},
            )) if ok), None)
            state = "named_together" if used[v] & used[survivor] else "no_evidence" if tier is None else None
            want[v] = (survivor, None if tier is None else E.EVIDENCE[tier], state)
            if state is None:
                asked.append((tier, -mentions[v], v))
        taken = set()
        for _, _, v in sorted(asked):
            want[v] = (*want[v][:2], "barred" if used[v] & taken else "fold")
            taken |= set() if used[v] & taken else used[v]
    assert {r.variant: (r.survivor, r.evidence, r.decision) for r in got.collect()} == want
    assert {w[2] for w in want.values()} >= {"fold"}


def test_every_decision_is_made(spark, tiny):
    """Bans and evidence of each kind matter."""
    got = QUERIES["variant_pairing"](spark, tiny.replace("sf0.001", "sf0.01")).groupBy("decision", "evidence").count().collect()
    assert {r.decision for r in got} == {"named_together", "no_evidence", "fold", "barred"}
    assert {r.evidence for r in got if r.decision == "fold"} == set(E.EVIDENCE)


SURFACES = [
    ("Q1", "Bharatiya Janata Party", "label"), ("Q1", "BJP", "alias"), ("Q2", "British Journal of Pharmacology", "label"), ("Q2", "BJP", "alias"),
    ("Q3", "Press Trust of India", "label"), ("Q3", "PTI", "alias"), ("Q4", "Hemangi Sharma", "label"), ("Q4", "Rahul", "alias"), ("Q4", "Sharma", "alias"),
    ("Q5", "Communist Party of India", "label"), ("Q6", "Communist Party of India (Marxist)", "label"), ("Q6", "Communist Party of India", "alias"),
    ("Q7", "Aam Aadmi Party", "label"), ("Q8", "Aam Aadmi Party", "label"), ("Q9", "Lok Dal", "label"), ("Q10", "Lok Dal", "label"), ("Q11", "Lok Dal", "alias"),
    ("Q12", "Twin", "sitelink"), ("Q13", "Twin", "sitelink"), ("", "Nothing", "label"), ("Q14", "—", "label"),
]
CONTEXT = [("Q1", False, ["in"]), ("Q2", False, ["uk"]), ("Q7", False, ["in"]), ("Q8", False, ["pk"]), ("Q9", True, ["in"]), ("Q10", False, ["uk"]), ("Q12", True, None), ("Q13", True, None)]


def test_identifiers_link_or_refuse(spark):
    names = ["bjp", "P.T.I", "pti", "Rahul", "SHARMA", "communist party of  india", "Aam Aadmi Party", "Lok Dal", "Twin", "unknown", "Nothing", ""]
    got = E.linked(
        spark.createDataFrame(list(enumerate(names)), "entity_id long, name string"), spark.createDataFrame(SURFACES, "qid string, surface string, kind string"),
        spark.createDataFrame(CONTEXT, "qid string, defunct boolean, countries array<string>"), "in",
    )
    found = {names[r.entity_id]: (r.qid, r.resolution, r.refused) for r in got.collect()}
    assert found == {
        "bjp": ("Q1", "alias_exact+home", None), "pti": ("Q3", "alias_exact", None), "SHARMA": ("Q4", "alias_exact", None),
        "communist party of  india": ("Q5", "label_wins", None), "Aam Aadmi Party": ("Q7", "alias_exact+home", None),
        # of the two labels the live one, but an alias is live too, and only then the label's tier wins
        "Lok Dal": ("Q10", "label_wins+live", None), "Twin": (None, None, ["Q12", "Q13"]),
    }


def test_groups_with_two_identifiers_are_refused(spark):
    rows = [(1, "brij-bhushan"), (2, "brijbhushan"), (3, "janta"), (4, "janata"), (5, "thawar-chand"), (6, "thawarchand"), (7, "alone"), (8, "other-name")]
    links = [(1, "Q1"), (8, "Q1"), (5, "Q5"), (6, "Q6"), (7, None)]
    got = E.fold_groups(
        spark.createDataFrame(rows, "entity_id long, slug string"), spark.createDataFrame(links, "entity_id long, qid string"), spark.createDataFrame([("janta", "janata")], "slug string, canonical string")
    )
    assert sorted(map(tuple, got.collect())) == [(1, 1, "Q1", False), (2, 1, "Q1", False), (3, 3, None, False), (4, 3, None, False), (5, 5, None, True), (6, 5, None, True), (8, 1, "Q1", False)]


def test_every_resolution_is_made(spark, tiny):
    found = {r.resolution for r in QUERIES["identifier_links"](spark, tiny.replace("sf0.001", "sf0.01")).select(F.col("resolution")).distinct().collect()}
    assert found == {"alias_exact", "sitelink_wins", "alias_exact+live", "alias_exact+home"}
