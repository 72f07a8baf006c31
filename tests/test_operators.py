"""Operators on literals, and properties of those without an SQL twin."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import quotes as Q
from recordloom.functions import text as T
from recordloom.functions import unicode as U
from recordloom.operators import relations as J
from recordloom.operators import stories as S
from recordloom.operators import vectors as V
from recordloom.operators.components import connected_components


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


def _roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(30)] + [(5, 5), (1, 2), (2, 1)]
    got = connected_components(spark.createDataFrame(edges + [(None, 4)], "u long, v long"))
    assert dict(got.collect()) == _roots([(a, b) for a, b in edges if a != b])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_redirect_roots_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "id long, target long")
    assert {r.id: r.root for r in J.redirect_roots(links).collect()} == {1: 4, 2: 4, 3: 4, 9: 8}
    assert J.redirect_roots(spark.createDataFrame([(1, 2), (2, 1)], "id long, target long")).count() == 2


def test_band_join_equals_nested_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), rng.randrange(100_000)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, k long, s long").withColumn("t", F.timestamp_seconds("s"))
    a, b = df.select("k", F.col("i").alias("a"), F.col("t").alias("ta")), df.select("k", F.col("i").alias("b"), F.col("t").alias("tb"))
    got = {(r.a, r.b) for r in J.band_join(a, b, ["k"], "ta", "tb", 5000).collect()}
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and abs(x[2] - y[2]) <= 5000}


def test_salted_co_occurrence_is_the_same(spark):
    rows = [(g, i) for g in range(5) for i in range(g + 3)]
    df = spark.createDataFrame(rows, "g long, i long")
    plain, salted = J.co_occurrence(df, "g", "i"), J.co_occurrence(df, "g", "i", salt=3)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))


def test_nearest_ties_and_floor(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = V.nearest(df, 2, block=2)
    assert [(r.nbr_id) for r in near.where("vec_id = 1").orderBy("rnk").collect()] == [2, 4]
    assert V.nearest(df, 3, floor=0.5).where("vec_id = 3").count() == 0


def test_communities_are_connected_and_stable(spark):
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(5), 2)] + [(a, b, 1.0) for a, b in itertools.combinations(range(10, 15), 2)] + [(4, 10, 0.01)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    got = dict(S.communities(df, 0.3).collect())
    assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == {frozenset(range(5)), frozenset(range(10, 15))}
    assert dict(S.communities(df.orderBy(F.rand(7)), 0.3).collect()) == got


def _potts(edges, label, resolution):
    size = {}
    for c in label.values():
        size[c] = size.get(c, 0) + 1
    return sum(w for a, b, w in edges if label[a] == label[b]) - resolution * sum(n * (n - 1) / 2 for n in size.values())


def test_communities_are_good_and_hang_together(spark):
    rng = random.Random(3)
    nodes = range(60)
    edges = [(a, b, 1.0) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.7 if a // 12 == b // 12 else 0.04)]
    got = dict(S.communities(spark.createDataFrame(edges, "a long, b long, weight double"), 0.3).collect())
    planted = {v: v // 12 for v in nodes}
    assert _potts(edges, got, 0.3) >= 0.97 * _potts(edges, planted, 0.3)
    for c in set(got.values()):
        own = {v for v in got if got[v] == c}
        seen, todo = set(), [min(own)]
        while todo:
            v = todo.pop()
            seen.add(v)
            todo += [y for x in ((a, b) for a, b, _ in edges) for y in x if v in x and y in own and y not in seen and y != v]
        assert seen == own and c == min(own)


def test_seed_community_by_greedy_modularity(spark):
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(5), 2)] + [(a, b, 1.0) for a, b in itertools.combinations(range(10, 15), 2)] + [(4, 10, 1.0)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    reach = S.bounded_reach(df, spark.createDataFrame([(0,), (12,)], "event_id long"), 4, 0.15)
    got = S.seed_communities(df, reach).collect()
    assert {(r.seed, r.event_id) for r in got} == {(0, v) for v in range(5)} | {(12, v) for v in range(10, 15)}


@pytest.mark.parametrize("hub_df", [256, 3])
@pytest.mark.parametrize("floor", [0.0, 0.4])
def test_shared_actors_equal_all_pairs(spark, floor, hub_df):
    rng = random.Random(hub_df)
    rows = sorted({(e, min(int(rng.expovariate(0.25)), 30)) for e in range(40) for _ in range(rng.randint(1, 7))})
    held, df = {}, {}
    for e, a in rows:
        held.setdefault(e, set()).add(a)
        df[a] = df.get(a, 0) + 1
    want = {}
    for x, y in itertools.combinations(sorted(held), 2):
        both = held[x] & held[y]
        if len(both) >= 2 and sum(1 / df[a] for a in both) >= floor:
            want[x, y] = (len(both), round(sum(1 / df[a] for a in both), 9), round(max(1 / df[a] for a in both), 9))
    keep = (F.col("shared") >= 2) & (F.col("weight") >= floor)
    got = S.shared_actors(spark.createDataFrame(rows, "event_id long, entity_id long"), keep, 2, floor, hub_df=hub_df).collect()
    assert {(r.a, r.b): (r.shared, round(r.weight, 9), round(r.rarest, 9)) for r in got} == want


def test_star_merge_equals_one_after_another(spark):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)})
    nodes = [(v, rng.randint(1, 4), rng.randint(0, 5)) for v in range(40)]
    near = {v: {x for p in pairs for x in p if v in p and x != v} for v in range(40)}
    taken, want = set(), set()
    order = sorted(range(40), key=lambda v: (-nodes[v][1], nodes[v][2], v))
    for n, v in enumerate(order):
        if v not in taken:
            for u in near[v] & set(order[n + 1 :]) - taken:
                taken.add(u)
                want.add((v, u))
    got = S.star_merge(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(nodes, "event_id long, outlets long, at long"))
    assert {tuple(r) for r in got.collect()} == want


def test_average_linkage_equals_one_merger_after_another(spark):
    rng = random.Random(5)
    sim = {p: round(rng.random(), 4) for p in itertools.combinations(range(16), 2) if rng.random() < 0.6}
    groups = [[v] for v in sorted({v for p in sim for v in p})]
    mean = lambda x, y: sum(sim.get((min(i, j), max(i, j)), 0.0) for i in x for j in y) / len(x) / len(y)
    while len(groups) > 1:
        best, i, j = max((mean(x, y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups[:i]))
        if best < 0.35:
            break
        groups[j] += groups.pop(i)
    df = spark.createDataFrame([(*p, s) for p, s in sim.items()], "a long, b long, sim double")
    assert dict(S.average_linkage(df, 0.35).collect()) == {v: min(g) for g in groups for v in g}


def test_branch_tree_on_literals(spark):
    members = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 1, 30), (4, 1, 40), (5, 1, 5)], "event_id long, component long, at long")
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.5), (2, 3, 0.4), (3, 4, 0.2)], "a long, b long, weight double")
    tree = S.branch_parents(members, edges, spark.createDataFrame([(1, 1)], "component long, root long"))
    assert {(r.event_id, r.parent_id) for r in tree.collect()} == {(1, None), (2, 1), (3, 1), (4, 3), (5, 1)}
    assert dict(S.tree_depths(tree).collect()) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 1}


def test_entities_fold_and_come_back(spark):
    named = spark.createDataFrame([(1, "k", "x", None), (2, "k", "x", "q"), (3, "k", "x", None), (4, "k", "y", "q"), (5, "k", "y", "r"), (6, "k", "y", "r"), (7, "k", "y", None)], "entity_id long, kind string, key string, ident string")
    folds = S.entity_folds(named)
    assert {(r.entity_id, r.target, r.why) for r in folds.collect()} == {(2, 1, "name"), (3, 1, "name"), (6, 5, "identifier")}
    mentions = spark.createDataFrame([(10, 1), (10, 2), (11, 3), (12, 2), (12, 3), (13, 6), (13, 5), (14, 7)], "event_id long, entity_id long")
    folded, journal = S.fold_entities(mentions, folds)
    assert {tuple(r) for r in folded.collect()} == {(10, 1), (11, 1), (12, 1), (13, 5), (14, 7)}
    assert sorted(map(tuple, S.restore_entities(folded, journal).collect())) == sorted(map(tuple, mentions.collect()))


def test_star_merge_needs_its_own_verdict(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    nodes = spark.createDataFrame([(1, 5, 1), (2, 4, 2), (3, 3, 3)], "event_id long, outlets long, at long")
    assert sorted(map(tuple, S.star_merge(pairs, nodes).collect())) == [(1, 2)]


def test_bounded_reach(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5), (4, 5, 0.5)], "a long, b long, weight double")
    got = S.bounded_reach(edges, spark.createDataFrame([(1,)], "event_id long"), 4, 0.15)
    assert {(r.event_id, r.hops) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://Example.COM:80/a?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("ftp://example.com/x", "ftp://example.com/x"),
        ("https://user:pw@example.com/", "https://user:pw@example.com/"),
        ("  ", None),
        ("https://example.com/?fbclid=1", "https://example.com/"),
    ],
)
def test_canonical_url_two_ways(spark, url, key):
    assert U.canonicalise_url(url) == key
    assert _one(spark, T.canonical_url(F.lit(url))) == key


def test_international_host():
    assert U.canonicalise_url("http://Bücher.example/") == "https://xn--bcher-kva.example/"


def test_markup_is_stripped_before_entities(spark):
    assert _one(spark, T.strip_tags(F.lit("<p>a &lt;b&gt; &amp; c</p>"))) == "a <b> & c"
    assert _one(spark, T.leaked_tags(F.lit("read /proc/<pid>/root"))) == 0
    assert _one(spark, T.leaked_tags(F.lit("<div>x</div>"))) == 2


@pytest.mark.parametrize(
    ("name", "folded"),
    [("D.K. Rao", "DK Rao"), ("Green Party (GP)", "Green Party"), ("ABC(M)", "ABC(M)"), ("V D Rao", "VD Rao"), ("R Nirmal Kumar", "R Nirmal Kumar"), ("O'Brien", "OBrien")],
)
def test_canonical_names(spark, name, folded):
    assert _one(spark, T.canonical_name(F.lit(name))) == folded


def test_slugs():
    assert U.slug("Ávila  Straße") == "avila-strasse"
    assert U.slug("नरेंद्र मोदी") == "नरेंद्र-मोदी"
    assert U.slug("!!!") == "unknown"


def test_chunks_cover_the_text():
    text = " ".join(f"Sentence number {i}." for i in range(400))
    parts = U.chunks(text)
    assert all(len(p) <= 1200 for p in parts) and len(parts) > 3
    assert all(f"Sentence number {i}." in " ".join(parts) for i in range(400))
    assert U.chunks("") == [] and U.chunks("short") == ["short"]


def test_sentences_know_abbreviations(spark):
    told = lambda text: _one(spark, T.sentences(F.lit(text)))
    assert told("Mr. Rao spoke. N. Rao left! 5.5 is left") == ["Mr. Rao spoke.", "N. Rao left!", "5.5 is left"]
    assert told(' He said "no."  Then\nhe left.\t') == ['He said "no."', "Then\nhe left."]
    assert told("By Dr. A. B. Rao. Ends with Mr.") == ["By Dr. A. B. Rao.", "Ends with Mr."]
    assert told("") == [] and told(" \n") == [] and _one(spark, T.sentences(F.lit(None).cast("string"))) is None


def test_sounds_come_from_letter_names():
    """One letter of each class in nine Brahmic scripts and Urdu."""
    for k, s, t, p, n, r, l in ("कचतपमरल", "কচতপমরল", "ਕਚਤਪਮਰਲ", "કચતપમરલ", "କଚତପମରଲ", "கசதபமரல", "కచతపమరల", "ಕಚತಪಮರಲ", "കചതപമരല", "کچتپمرل"):
        assert [U._native_sound(x) for x in (k, s, t, p, n, r, l)] == list("kstpnrl")
    assert [U._native_sound(x) for x in "खघ\u0958\u0959\u095aज\u095bशषटठडढदधफभ\u095eणञङंँऋ\u095c\u095d\u0931ळ"] == list("kkkkkssss" "tttttt" "ppp" "nnnnn" "rrrrl")
    assert [U._native_sound(x) for x in "خغقکكگثجذزژسشصضظتٹدڈطبفنںرڑ"] == list("kkkkkk" "ssssssssss" "ttttt" "pp" "nn" "rr")
    assert not any(U._native_sound(x) for x in "अआइयवहाि्ः़।०۔حعہهیوءا")


def test_frames_inside_reported_words():
    quotative = "ಸರ್ಕಾರ ಬರುತ್ತದೆ ಎಂದು"
    assert Q.framed(f"{quotative} ಅವರು ಸಭೆಯಲ್ಲಿ ಹೇಳಿದರು. ಮತ್ತೆ", "kn") and Q.framed(f"{quotative} {'ಅವರು ' * 8}ಹೇಳಿದರು.", "kn")
    assert not Q.framed(f"{quotative} {'ಅವರು ' * 9}ಹೇಳಿದರು.", "kn") and not Q.framed(f"{quotative} ಹೇಳಿದರು ಅವರು.", "kn")
    assert not Q.framed(quotative, "kn") and not Q.framed("", "kn") and not Q.framed("he said so.", "en")


def test_scripts(spark):
    assert _one(spark, T.script_of(F.lit("ಕನ್ನಡ text"))) == "kannada"
    assert _one(spark, T.script_of(F.lit("اردو"))) == "arabic"
    assert _one(spark, T.script_of(F.lit("plain"))) == "latin"
    assert not _one(spark, T.is_latin(F.lit("हिन्दी UPSC")))


def test_skeletons(spark):
    assert _one(spark, T.skeleton(F.lit("smith-machar"))) == "smt mcr"
    assert U.cross_script_skeleton("मोदी") == U.cross_script_skeleton("Modi")


def test_hashes(spark):
    assert _one(spark, T.hamming_hex(F.lit("ffffffffffffffff"), F.lit("fffffffffffffffe"))) == 1
    rising = F.array(*[F.lit(i) for i in range(72)])
    assert _one(spark, T.dhash(rising)) == "0" * 16


def test_direct_speech():
    text = 'He arrived late. "We will not pay this tax," she said. Others left.'
    assert Q.check(text, "We will not pay this tax", "Asha Rao") == "direct"
    assert Q.check(text, "He arrived late", "Asha Rao") == "not_quoted"
    assert Q.check(text, "never said at all", "Asha Rao") == "not_verbatim"
    assert Q.check('They called it "unlawful, cruel, wrong" again', "unlawful, cruel, wrong", "Asha Rao") == "fragment"
    assert Q.check('"We will go now, Rao said to them today"', "We will go now, Rao said to them today", "Asha Rao") == "narration"
    assert not Q.is_direct('It\'s a lost mark "here\nWe will not pay this tax', 24, 48)


@pytest.mark.parametrize(
    ("lang", "text", "words", "verdict"),
    [
        ("hi", "राहुल गांधी ने कहा कि हम यह कर नहीं देंगे। फिर", "हम यह कर नहीं देंगे", "reported"),
        ("hi", "मंत्री ने कहा कि हम यह कर नहीं देंगे। फिर", "हम यह कर नहीं देंगे", "not_named"),
        ("hi", "राहुल गांधी आए। हम यह कर नहीं देंगे", "हम यह कर नहीं देंगे", "not_quoted"),
        ("hi", "राहुल गांधी ने कहा कि हम यह कर राहुल गांधी नहीं देंगे", "हम यह कर राहुल गांधी नहीं देंगे", "narration"),
        ("mr", "राहुल गांधी म्हणाले, आम्ही हा कर देणार नाही आज", "आम्ही हा कर देणार नाही", "reported"),
        ("gu", "રાહુલ ગાંધીએ કહ્યું કે અમે આ કર નહીં આપીએ આજે", "અમે આ કર નહીં આપીએ", "reported"),
        ("pa", "ਰਾਹੁਲ ਗਾਂਧੀ ਨੇ ਕਿਹਾ ਕਿ ਅਸੀਂ ਇਹ ਕਰ ਨਹੀਂ ਦੇਵਾਂਗੇ", "ਅਸੀਂ ਇਹ ਕਰ ਨਹੀਂ ਦੇਵਾਂਗੇ", "reported"),
        ("bn", "রাহুল গান্ধী বলেন, আমরা এই কর দেব না আজ", "আমরা এই কর দেব না", "reported"),
        ("or", "ରାହୁଲ ଗାନ୍ଧୀ କହିଛନ୍ତି ଯେ ଆମେ ଏହି କର ଦେବୁ ନାହିଁ", "ଆମେ ଏହି କର ଦେବୁ ନାହିଁ", "reported"),
        ("as", "ৰাহুল গান্ধীয়ে কয় আমি এই কৰ নিদিওঁ আজি", "আমি এই কৰ নিদিওঁ আজি", "reported"),
        ("ta", "ராகுல் காந்தி, இந்த வரியை நாங்கள் செலுத்த மாட்டோம் என்று கூறினார்.", "இந்த வரியை நாங்கள் செலுத்த மாட்டோம்", "reported"),
        ("te", "రాహుల్ గాంధీ ఈ పన్ను మేము ఎప్పుడూ కట్టం అని అన్నారు.", "ఈ పన్ను మేము ఎప్పుడూ కట్టం", "reported"),
        ("kn", "ರಾಹುಲ್ ಗಾಂಧಿ ಅವರು ಈ ತೆರಿಗೆ ನಾವು ಕಟ್ಟುವುದಿಲ್ಲ ಎಂದು ಹೇಳಿದರು.", "ಈ ತೆರಿಗೆ ನಾವು ಕಟ್ಟುವುದಿಲ್ಲ", "reported"),
        ("kn", "ರಾಹುಲ್ ಗಾಂಧಿ ಅವರು ಈ ತೆರಿಗೆ ನಾವು ಕಟ್ಟುವುದಿಲ್ಲ ಎಂದು. ಹೇಳಿದರು", "ಈ ತೆರಿಗೆ ನಾವು ಕಟ್ಟುವುದಿಲ್ಲ", "not_quoted"),
        ("ml", "രാഹുൽ ഗാന്ധി ഈ നികുതി ഞങ്ങൾ കൊടുക്കില്ല എന്ന് പറഞ്ഞു.", "ഈ നികുതി ഞങ്ങൾ കൊടുക്കില്ല", "reported"),
        ("ur", "راہل گاندھی نے کہا کہ ہم یہ ٹیکس نہیں دیں گے", "ہم یہ ٹیکس نہیں دیں", "reported"),
        ("en", "Rahul Gandhi said that we will not pay this tax", "we will not pay this tax", "not_quoted"),
    ],
)
def test_reported_speech(lang, text, words, verdict):
    assert Q.check(text, words, "Rahul Gandhi", lang) == verdict


def test_names_across_scripts():
    assert U.cross_script_skeleton("Siddaramaiah") == U.cross_script_skeleton("ಸಿದ್ದರಾಮಯ್ಯ") == "strn"
    assert U.named_in("Siddaramaiah", "ಮುಖ್ಯಮಂತ್ರಿ ಸಿದ್ದರಾಮಯ್ಯನವರು ಹೇಳಿದರು") and not U.named_in("Siddaramaiah", "ಮುಖ್ಯಮಂತ್ರಿ ಹೇಳಿದರು")
    assert U.named_in("M. K. Stalin", "முதல்வர் ஸ்டாலின் கூறினார்") and not U.named_in("", "ஸ்டாலின்")


def test_nearest_naming():
    text = "Asha Rao said we go now. Then Vikram Sen left."
    at = text.index("we go now")
    assert Q.naming_gap(text, at, at + 9, "Asha Rao") == 6 and Q.naming_gap(text, at, at + 9, "Vikram Sen") is None
    assert Q.naming_gap("we go now, Rao said", 0, 9, "Asha Rao") == 2 and Q.naming_gap("x" * 300 + " we go now", 301, 310, "Asha Rao") is None
    assert Q.naming_gap("Asha Rao. " + "y " * 120 + "we go now", 250, 259, "Asha Rao") is None


def test_roles():
    assert Q.faithful_role("Chief Minister of Kerala", "the chief minister of Kerala said") == "Chief Minister of Kerala"
    assert Q.faithful_role("lawyer of the Moon", "a lawyer spoke") == "lawyer"
    assert Q.faithful_role("Minister (Other State)", "minister") is None
    assert Q.faithful_role(None, "x") is None


def test_names_fold_into_one_longer():
    assert Q.fold_names(["Singh", "Saheb Singh"]) == {"Singh": "Saheb Singh", "Saheb Singh": "Saheb Singh"}
    assert Q.fold_names(["Singh", "Saheb Singh", "Jarnail Singh"])["Singh"] == "Singh"


def test_quotes_collapse(spark):
    rows = [
        (1, "Rao", "We will not pay this tax at all", "b", 2.0, 5.0), (1, "Asha Rao", "We will not pay this tax at all", "a", 1.0, 9.0),
        (1, "Das", "A quite different thing was said here", "a", 1.0, None), (1, "Roy", "Nobody knows who said these words", "a", 1.0, None), (1, "Sen", "Nobody knows who said these words", "b", 1.0, None),
    ]
    got = Q.collapse_quotes(spark.createDataFrame(rows, "record long, speaker string, quote string, source string, published double, gap double")).collect()
    assert {(r.speaker, r.source, r.also) for r in got} == {("Asha Rao", "a", 1), ("Das", "a", 0)}


def test_transcript_windows():
    got = Q.windows([(0, 20, "a"), (20, 35, "b"), (35, 90, "c"), (90, 95, "")])
    assert [(s, e, t) for _, s, e, t in got] == [(0, 35, "a b"), (35, 90, "c")]


def test_quote_verdicts_of_words_that_are_a_list(spark, tmp_path):
    """A document whose first five words are "or" and "and" has its frame's verdict; the words alone are a fragment."""
    from recordloom.plans import streams

    runs = ["are or or or or", "nou and and and and"]
    docs = [(7 * j + i, f"{run}. More words", "en", "s") for i in range(7) for j, run in enumerate(runs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.verdict, r.role) for r in streams.quote_verdicts(spark, str(tmp_path)).collect()}
    assert got == {d[0]: streams._FRAMES[d[0] % 7][4:] for d in docs}
    assert all(Q.check(f'They said: "{run}." Then', run, "Asha Rao") == "fragment" for run in runs)
