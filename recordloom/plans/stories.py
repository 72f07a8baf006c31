"""Matching cascade, graphs, stories, search and evaluation on the bound relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import records as R
from recordloom.operators import relations as J
from recordloom.operators import stories as S
from recordloom.operators import vectors as V
from recordloom.operators.sparse import jaccard_pairs
from recordloom.plans.bind import DOSSIER_NODES, DOSSIERS, MENTIONS, RECORDS, REPORTS, Tables
from recordloom.plans.registry import query
from recordloom.storage import stored

#: Weight of an edge between dossiers, and the weight of a root's actors that keeps a member on its spine.
FLOOR = 0.2
SPINE = 0.05
RESOLUTION = 0.05
_DF = "d AS (SELECT entity_id, count(*) AS df FROM mentions GROUP BY entity_id)"
_EDGES = f"""{DOSSIERS}, {_DF}, edges AS (SELECT x.event_id AS a, y.event_id AS b, count(*) AS shared, sum(1.0 / df) AS weight FROM mentions x JOIN mentions y ON x.entity_id = y.entity_id AND x.event_id < y.event_id JOIN d ON d.entity_id = x.entity_id
  GROUP BY ALL HAVING count(*) >= 2 AND sum(1.0 / df) >= {FLOOR})"""
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_SIMS = f"{_UNIT}, sims AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id)"
_REACH = """adj AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT x AS node, x AS r FROM adj UNION SELECT reach.node, adj.y FROM reach JOIN adj ON reach.r = adj.x),
  comp AS (SELECT node AS event_id, min(r) AS component FROM reach GROUP BY node)"""


def _edges(t: Tables):
    """The actor edges between dossiers, stored once for all that reads them."""
    return stored(S.actor_edges(t.dossiers, FLOOR), "actor_edges")


def _members(t: Tables, edges):
    return stored(S.components(edges).join(t.dossier_nodes, "event_id"), "members")


@query("actor_edges", f"WITH {_EDGES} SELECT a, b, shared, round(weight, 6) AS weight FROM edges")
def actor_edges(spark, sf_dir):
    """GR1 JN2 MC8: records linked by shared rare actors."""
    return S.actor_edges(Tables(spark, sf_dir).dossiers, FLOOR).select("a", "b", "shared", F.round("weight", 6).alias("weight"))


@query("connected_stories", f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT event_id, component FROM comp")
def connected_stories(spark, sf_dir):
    """GR5: connected components of the actor edges."""
    return S.components(_edges(Tables(spark, sf_dir)))


@query(
    "story_cast",
    f"""WITH RECURSIVE {_EDGES}, {_REACH}, n AS (SELECT component, p_name AS name, count(DISTINCT m.event_id) AS n FROM comp JOIN mentions m USING (event_id) JOIN part ON p_partkey = entity_id GROUP BY ALL HAVING count(DISTINCT m.event_id) >= 2)
    SELECT component, name, n FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, name) AS k FROM n) WHERE k <= 8""",
)
def story_cast(spark, sf_dir):
    """AG15 GR13: names on two records of a component, the top eight."""
    t = Tables(spark, sf_dir)
    named = S.components(_edges(t)).join(t.dossiers, "event_id").join(t.actors.select("entity_id", "name"), "entity_id")
    n = named.select("component", "name", "event_id").distinct().groupBy("component", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return R.top_per_group(n, ["component"], [F.desc("n"), F.asc("name")], 8).select("component", "name", "n")


_ROOTS = f"""{DOSSIER_NODES}, m AS (SELECT event_id, component, outlets, told FROM comp JOIN nodes USING (event_id)),
  roots AS (SELECT component, event_id AS root, outlets FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY outlets DESC, told, event_id) AS k FROM m) WHERE k = 1)"""


@query("root_selection", f"WITH RECURSIVE {_EDGES}, {_REACH}, {_ROOTS} SELECT component, root FROM roots")
def root_selection(spark, sf_dir):
    """GR9: a story's root has most outlets, then is earliest, then lowest."""
    t = Tables(spark, sf_dir)
    return S.story_roots(_members(t, _edges(t)))


_TREE = f"""{_ROOTS}, w AS (SELECT a AS c, b AS p, weight FROM edges UNION ALL SELECT b, a, weight FROM edges), size AS (SELECT component, count(*) AS n, arg_min(event_id, (told, event_id)) AS earliest FROM m GROUP BY component),
  pull AS (SELECT p, sum(weight) / (any_value(n) - 1) AS pull FROM w JOIN m ON m.event_id = p JOIN size USING (component) GROUP BY p),
  f AS (SELECT w.c, w.p, row_number() OVER (PARTITION BY w.c ORDER BY round(weight / pull, 9) DESC, mp.told, w.p) AS k FROM w JOIN m mc ON mc.event_id = w.c JOIN m mp ON mp.event_id = w.p AND (mp.told, mp.event_id) < (mc.told, mc.event_id) JOIN pull ON pull.p = w.p),
  tree AS (SELECT m.event_id, m.component, CASE WHEN m.event_id = root THEN NULL ELSE coalesce(f.p, CASE WHEN m.event_id <> earliest THEN earliest ELSE root END) END AS parent_id
    FROM m JOIN size USING (component) JOIN roots USING (component) LEFT JOIN f ON f.c = m.event_id AND f.k = 1)"""


def _tree(t: Tables):
    edges = _edges(t)
    members = _members(t, edges)
    roots = stored(S.story_roots(members), "roots")
    return members, roots, S.branch_parents(members, edges, roots)


@query("branch_tree", f"WITH RECURSIVE {_EDGES}, {_REACH}, {_TREE} SELECT event_id, parent_id FROM tree")
def branch_tree(spark, sf_dir):
    """GR10 GR11: each development hangs on the earlier one that pulls it most, over that one's pull on all."""
    return _tree(Tables(spark, sf_dir))[2].select("event_id", "parent_id")


@query(
    "off_spine",
    f"""WITH RECURSIVE {_EDGES}, {_REACH}, {_ROOTS}, spine AS (SELECT component, entity_id, 1.0 / df AS w FROM roots JOIN mentions ON root = event_id JOIN d USING (entity_id)),
    s AS (SELECT event_id, sum(w) AS w FROM m JOIN mentions USING (event_id) JOIN spine USING (component, entity_id) GROUP BY event_id)
    SELECT m.event_id, round(coalesce(w, 0), 9) < {SPINE} AS off_spine FROM m LEFT JOIN s USING (event_id)""",
)
def off_spine(spark, sf_dir):
    """GR10: members that share too little of their root's distinctive actors."""
    t = Tables(spark, sf_dir)
    members = _members(t, _edges(t))
    return S.off_spine(members, S.story_roots(members), stored(t.dossiers, "dossiers"), SPINE)


@query(
    "tree_shape",
    f"""WITH RECURSIVE {_EDGES}, {_REACH}, {_TREE}, walk AS (SELECT event_id, component, 0 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT tree.event_id, tree.component, depth + 1 FROM walk JOIN tree ON tree.parent_id = walk.event_id)
    SELECT component, CAST(max(depth) AS INTEGER) AS depth, count(*) AS n, CAST(max(fan) AS BIGINT) AS widest FROM walk LEFT JOIN (SELECT parent_id, count(*) AS fan FROM tree GROUP BY parent_id) c ON c.parent_id = event_id GROUP BY component""",
)
def tree_shape(spark, sf_dir):
    """GR12: depth, size and widest fan of story trees, depths by doubling steps."""
    _, _, tree = _tree(Tables(spark, sf_dir))
    tree = stored(tree, "tree")
    fan = tree.groupBy(F.col("parent_id").alias("event_id")).agg(F.count(F.lit(1)).alias("fan"))
    rows = tree.join(S.tree_depths(tree), "event_id").join(fan, "event_id", "left")
    return rows.groupBy("component").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"), F.max("fan").alias("widest"))


@query("story_communities")
def story_communities(spark, sf_dir):
    """GR6: Leiden communities under the constant Potts model."""
    return S.communities(_edges(Tables(spark, sf_dir)).select("a", "b", "weight"), RESOLUTION)


_REACHED = f"""e AS (SELECT a AS x, b AS y, least(weight * 2, 1.0) AS s FROM edges UNION ALL SELECT b, a, least(weight * 2, 1.0) FROM edges), asked AS (SELECT DISTINCT x AS seed FROM e WHERE x % 10 = 0),
  walk AS (SELECT seed, seed AS event_id, 0 AS hops, CAST(1.0 AS DOUBLE) AS s FROM asked UNION SELECT seed, y, hops + 1, walk.s * e.s FROM walk JOIN e ON e.x = walk.event_id WHERE hops < 3 AND walk.s * e.s >= 0.15)"""


@query("bounded_reach", f"WITH RECURSIVE {_EDGES}, {_REACHED} SELECT seed, event_id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY seed, event_id")
def bounded_reach(spark, sf_dir):
    """GR8: records within three decaying steps of each tenth record."""
    return _reach(_edges(Tables(spark, sf_dir)))


def _reach(edges):
    near = edges.select("a", "b", (F.col("weight") * 2).alias("weight"))
    seeds = edges.select(F.col("a").alias("event_id")).union(edges.select("b")).where(F.col("event_id") % 10 == 0).distinct()
    return S.bounded_reach(near, seeds, 3, 0.15).select("seed", "event_id", "hops")


@query("seed_communities")
def seed_communities(spark, sf_dir):
    """GR7: a seed's community by greedy modularity in its bounded reach."""
    edges = _edges(Tables(spark, sf_dir))
    return S.seed_communities(edges, _reach(edges))


@query("cosine_topk", f"WITH {_SIMS} SELECT vec_id, nbr_id, CAST(rnk AS INTEGER) AS rnk, sim FROM (SELECT a AS vec_id, b AS nbr_id, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rnk FROM sims) WHERE rnk <= 5")
def cosine_topk(spark, sf_dir):
    """DM5 MC7 MC9 SR2: exact nearest neighbours by cosine, blocked."""
    return V.nearest(Tables(spark, sf_dir).vectors, 5, digits=6)


@query(
    "mutual_knn",
    f"WITH {_SIMS}, k AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims) WHERE n <= 4) SELECT x.a, x.b, x.sim FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
)
def mutual_knn(spark, sf_dir):
    """GR2 JN16: pairs in each other's four nearest."""
    return V.mutual(V.nearest(Tables(spark, sf_dir).vectors, 4, digits=6))


@query(
    "edge_union",
    f"""WITH {_SIMS}, {_EDGES}, k AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims) WHERE n <= 4), m AS (SELECT x.a, x.b, x.sim FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b),
    h AS (SELECT a, b, round(weight, 6) AS w FROM edges WHERE a IN (SELECT vec_id FROM embeddings) AND b IN (SELECT vec_id FROM embeddings))
    SELECT coalesce(m.a, h.a) AS a, coalesce(m.b, h.b) AS b, round(coalesce(sim, 0) + 2.0 * coalesce(CAST(w AS DOUBLE), 0), 6) AS weight FROM m FULL JOIN h ON m.a = h.a AND m.b = h.b""",
)
def edge_union(spark, sf_dir):
    """GR3: mutual neighbours and actor edges (of dossiers that have a vector) as one list, weights added."""
    t = Tables(spark, sf_dir)
    mutual = V.mutual(V.nearest(t.vectors, 4, digits=6)).withColumnRenamed("sim", "weight")
    ids = t.vectors.select("vec_id")
    second = _edges(t).join(ids.withColumnRenamed("vec_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("vec_id", "b"), "b", "left_semi")
    return S.edge_union(mutual, second.select("a", "b", F.round("weight", 6).alias("weight")), 2.0).select("a", "b", F.round("weight", 6).alias("weight"))


_CENTRE = f"""{_UNIT}, x AS (SELECT label, unnest(v) AS v, unnest(range(len(v))) AS i FROM u), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i) GROUP BY label),
  near AS (SELECT vec_id, u.label AS gold, c.label AS label, round(1 - list_cosine_similarity(v, c), 6) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, c.label) AS k FROM u, c)"""


def _nearest_centroid(t: Tables):
    c = V.centroids(t.vectors, "label", "embedding").withColumnRenamed("label", "id")
    near = V.nearest_to(t.vectors, c, 3)  # of the closest, the one that leads after rounding
    order = Window.partitionBy("vec_id").orderBy(F.desc(F.round("sim", 9)), "nbr_id")
    first = near.withColumn("k", F.row_number().over(order)).where(F.col("k") == 1)
    return first.join(t.vectors.select("vec_id", F.col("label").alias("gold")), "vec_id").select("vec_id", "gold", F.col("nbr_id").cast("int").alias("label"), F.round(1 - F.col("sim"), 6).alias("dist"))


@query("story_centroid", f"WITH {_CENTRE} SELECT vec_id, label, dist FROM near WHERE k = 1")
def story_centroid(spark, sf_dir):
    """AG21 GR16: each vector's nearest centroid."""
    return _nearest_centroid(Tables(spark, sf_dir)).select("vec_id", "label", "dist")


@query(
    "b_cubed",
    f"""WITH {_CENTRE}, e AS (SELECT label, gold, count(*) AS n FROM near WHERE k = 1 GROUP BY ALL), f AS (SELECT *, sum(n) OVER (PARTITION BY label) AS p, sum(n) OVER (PARTITION BY gold) AS g FROM e),
    s AS (SELECT sum(n * n / p) / sum(n) AS precision, sum(n * n / g) / sum(n) AS recall FROM f), t AS (SELECT avg(top / n) AS purity FROM (SELECT label, max(n) AS top, sum(n) AS n FROM e GROUP BY label))
    SELECT round(CAST(precision AS DOUBLE), 6) AS precision, round(CAST(recall AS DOUBLE), 6) AS recall, round(CAST(2 * precision * recall / (precision + recall) AS DOUBLE), 6) AS f1, round(CAST(purity AS DOUBLE), 6) AS purity FROM s, t""",
)
def b_cubed(spark, sf_dir):
    """EV1 EV2: B-cubed precision, recall, F1, and macro purity."""
    out = S.b_cubed(_nearest_centroid(Tables(spark, sf_dir)), "label", "gold")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "purity")])


_PAIRS = f"{_UNIT}, p AS (SELECT round(list_cosine_similarity(a.v, b.v), 3) AS sim, a.label = b.label AS same FROM u a JOIN u b ON a.vec_id < b.vec_id)"


def _label_pairs(t: Tables):
    """All pairs of vectors, counted by rounded cosine and agreement of labels."""
    return V.similarity_counts(t.vectors, "label")


def _n(condition):
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


@query("auc_same_label", f"WITH {_PAIRS}, e AS (SELECT sim, count(*) FILTER (same) AS p, count(*) FILTER (NOT same) AS n FROM p GROUP BY sim), r AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY sim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e) SELECT round(CAST(sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS DOUBLE), 4) AS auc FROM r")
def auc_same_label(spark, sf_dir):
    """EV5: how well cosine ranks pairs of one label above others."""
    return S.auc(_label_pairs(Tables(spark, sf_dir)), "sim", F.col("same")).select(F.round("auc", 4).alias("auc"))


_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query(
    "threshold_sweep",
    f"""WITH {_PAIRS}, g AS (SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS threshold FROM generate_series(1, 19) s(i)), c AS (SELECT threshold, count(*) FILTER (same AND sim >= threshold) AS tp, count(*) FILTER (NOT same AND sim >= threshold) AS fp, count(*) FILTER (same AND sim < threshold) AS fn, count(*) FILTER (NOT same) AS neg FROM p, g GROUP BY threshold)
    SELECT threshold, tp, fp, fn, round(fn / (tp + fn) + 4 * fp / neg, 6) AS cdet FROM c""",
)
def threshold_sweep(spark, sf_dir):
    """EV3 EV6: counts and detection cost over a grid of thresholds."""
    c = S.threshold_sweep(_label_pairs(Tables(spark, sf_dir)), "sim", F.col("same"), _GRID)
    cost = S.detection_cost(F.col("fn"), F.col("fp"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"))
    return c.select("threshold", "tp", "fp", "fn", F.round(cost, 6).alias("cdet"))


@query(
    "weighted_detection_cost",
    f"""WITH {_PAIRS}, c AS (SELECT count(*) FILTER (same AND sim >= 0.1) AS tp, count(*) FILTER (NOT same AND sim >= 0.1) AS fp, count(*) FILTER (same AND sim < 0.1) AS fn, count(*) FILTER (NOT same) AS neg FROM p)
    SELECT round((0.02 * fn / (tp + fn) + 0.1 * 0.98 * fp / neg) / 0.02, 6) AS cdet, round(tp / (tp + fp), 6) AS precision FROM c""",
)
def weighted_detection_cost(spark, sf_dir):
    """EV3: the prior-weighted detection cost at one threshold."""
    p, same = _label_pairs(Tables(spark, sf_dir)), F.col("same")
    c = p.agg(_n(same & (F.col("sim") >= 0.1)).alias("tp"), _n(~same & (F.col("sim") >= 0.1)).alias("fp"), _n(same & (F.col("sim") < 0.1)).alias("fn"), _n(~same).alias("neg"))
    cost = S.weighted_detection_cost(F.col("fn"), F.col("fp"), F.col("tp") + F.col("fn"), F.col("neg"))
    return c.select(F.round(cost, 6).alias("cdet"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"))


@query("label_agreement", "SELECT quality, toxic, count(*) AS n, round((count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE)), 6) AS share FROM labels GROUP BY quality, toxic")
def label_agreement(spark, sf_dir):
    """The contingency of two labellings with shares."""
    labels = Tables(spark, sf_dir).raw("labels")
    total = labels.agg(F.count(F.lit(1)).alias("t"))
    n = labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    return n.select("quality", "toxic", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(
    "label_kappa",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree, count(*) FILTER (quality = 1) AS q, count(*) FILTER (toxic = 1) AS t FROM labels), p AS (SELECT agree / n AS po, (q / n) * (t / n) + (1 - q / n) * (1 - t / n) AS pe FROM c) SELECT round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS agreement FROM p""",
)
def label_kappa(spark, sf_dir):
    """EV10: two labellers' agreement, and that beyond chance."""
    c = Tables(spark, sf_dir).raw("labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("agree"), F.count_if(F.col("quality") == 1).alias("q"), F.count_if(F.col("toxic") == 1).alias("t"))
    q, t, po = F.col("q") / F.col("n"), F.col("t") / F.col("n"), F.col("agree") / F.col("n")
    pe = q * t + (1 - q) * (1 - t)
    return c.select(F.round((po - pe) / (1 - pe), 6).alias("kappa"), F.round(po, 6).alias("agreement"))


@query(
    "wilson_interval",
    """WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, n, round((hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM c""",
)
def wilson_interval(spark, sf_dir):
    """Bounds of a labelled share per source."""
    t = Tables(spark, sf_dir)
    c = t.raw("labels").join(t.raw("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return c.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("held_out_split", "SELECT doc_id, ('0x' || substr(md5('split:' || CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 10 < 3 AS held_out FROM labels")
def held_out_split(spark, sf_dir):
    """EV13: a hash split of labelled rows."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("long") % 10
    return Tables(spark, sf_dir).raw("labels").select("doc_id", (bucket < 3).alias("held_out"))


@query(
    "match_cascade",
    r"""WITH h AS (SELECT doc_id, source, md5(text) AS m, split_part(text, chr(10), 1) AS t, list_distinct(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{M}\p{N}]+'), lambda w: length(w) >= 6)) AS w FROM documents),
    c AS (SELECT a.doc_id, b.doc_id AS match_id, 1 AS tier, 1.0 AS score FROM h a JOIN h b ON a.m = b.m AND b.doc_id < a.doc_id
      UNION ALL SELECT a.doc_id, b.doc_id, 2, 0.9 FROM h a JOIN h b ON a.t = b.t AND a.source = b.source AND b.doc_id < a.doc_id
      UNION ALL SELECT a.doc_id, b.doc_id, 3, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) FROM h a JOIN h b ON a.source = b.source AND b.doc_id < a.doc_id AND len(list_intersect(a.w, b.w)) >= 2)
    SELECT doc_id, match_id, tier, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, match_id) AS k FROM c WHERE tier < 3 OR score >= 0.4) WHERE k = 1""",
)
def match_cascade(spark, sf_dir):
    """MC0 MC2 MC3 MC11: every tier proposes, the strongest wins."""
    d = Tables(spark, sf_dir).documents
    head = F.substring_index("text", "\n", 1)
    long_words = F.array_distinct(F.filter(T.words(head), lambda w: F.length(w) >= 6))
    h = d.select("doc_id", "source", F.md5("text").alias("m"), head.alias("t"), long_words.alias("w"))
    # the best match on a whole key is the least id that has it
    least = lambda *keys: F.min("doc_id").over(Window.partitionBy(*keys))
    first = h.select("doc_id", least("m").alias("one"), least("t", "source").alias("two"))
    exact = first.where(F.col("one") < F.col("doc_id")).select("doc_id", F.col("one").alias("match_id"), F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    title = first.where(F.col("two") < F.col("doc_id")).select("doc_id", F.col("two").alias("match_id"), F.lit(2).alias("tier"), F.lit(0.9).alias("score"))
    # documents meet on their rare words only, and are compared on all of them
    word = h.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), F.explode("w").alias("term"))
    shared = jaccard_pairs(word, 0.4, least=2, by_group=True)
    score = F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6)
    best = shared.groupBy(F.col("b").alias("doc_id")).agg(F.min(F.struct((-score).alias("n"), F.col("a").alias("match_id"))).alias("m"))
    words = best.select("doc_id", "m.match_id", F.lit(3).alias("tier"), (-F.col("m.n")).alias("score"))
    return S.first_hit(exact.unionByName(title).unionByName(words), "doc_id", "match_id").select("doc_id", "match_id", "tier", "score")


@query(
    "shared_identifiers",
    f"""WITH {RECORDS}, i AS (SELECT event_id, first_seen, author_id * 5 + event_id % 5 AS cve FROM records) SELECT a.event_id, arg_max(b.event_id, (b.first_seen, b.event_id)) AS match_id FROM i a JOIN i b ON a.cve = b.cve AND b.event_id <> a.event_id GROUP BY a.event_id""",
)
def shared_identifiers(spark, sf_dir):
    """MC1: a shared identifier matches the newest record that has it."""
    i = Tables(spark, sf_dir).records.select("event_id", "first_seen", (F.col("author_id") * 5 + F.col("event_id") % 5).alias("cve"))
    two = R.top_per_group(i, ["cve"], [F.desc("first_seen"), F.desc("event_id")], 2, "n").groupBy("cve").agg(
        F.max(F.when(F.col("n") == 1, F.col("event_id"))).alias("first"), F.max(F.when(F.col("n") == 2, F.col("event_id"))).alias("second")
    )
    match = F.when(F.col("first") != F.col("event_id"), F.col("first")).otherwise(F.col("second"))
    return i.join(two.where(F.col("second").isNotNull()), "cve").select("event_id", match.alias("match_id"))


@query(
    "verified_verdicts",
    f"""WITH {_SIMS}, k AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims) WHERE n <= 4), p AS (SELECT x.a, x.b, x.sim FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b),
    v AS (SELECT p.a, p.b, round(0.5 + sim, 6) AS r1, round(0.5 + list_cosine_similarity(x.v[1:32], y.v[1:32]), 6) AS r2 FROM p JOIN u x ON x.vec_id = p.a JOIN u y ON y.vec_id = p.b)
    SELECT a, b, CASE WHEN r1 >= 0.9 THEN 'verified' WHEN r1 >= 0.8 AND least(r1, r2) >= 0.8 THEN 'escalated' WHEN r1 >= 0.75 AND r2 < 0.9 THEN 'proposed' ELSE 'none' END AS verdict FROM v""",
)
def verified_verdicts(spark, sf_dir):
    """MC10: verdicts on mutual neighbours by floors, the doubtful read again on half the dimensions."""
    v = Tables(spark, sf_dir).vectors
    p = V.mutual(V.nearest(v, 4, digits=6))
    half = F.slice("embedding", 1, 32)
    p = p.join(v.select(F.col("vec_id").alias("a"), half.alias("x")), "a").join(v.select(F.col("vec_id").alias("b"), half.alias("y")), "b")
    p = p.select("a", "b", F.round(F.lit(0.5) + F.col("sim"), 6).alias("r1"), F.round(F.lit(0.5) + V.cosine(F.col("x"), F.col("y")), 6).alias("r2"))
    r1, r2 = F.col("r1"), F.col("r2")
    verdict = F.when(r1 >= 0.9, "verified").when((r1 >= 0.8) & (F.least(r1, r2) >= 0.8), "escalated").when((r1 >= 0.75) & (r2 < 0.9), "proposed").otherwise("none")
    return p.select("a", "b", verdict.alias("verdict"))


@query(
    "identical_body_guard",
    """WITH m AS (SELECT md5(substr(text, length(split_part(text, chr(10), 1)) + 1)) AS body, doc_id, md5(split_part(text, chr(10), 1)) AS title FROM documents), n AS (SELECT body FROM m GROUP BY body HAVING count(DISTINCT title) >= 1 AND count(*) >= 2) SELECT doc_id, body IN (SELECT body FROM n) AS guarded FROM m""",
)
def identical_body_guard(spark, sf_dir):
    """MC6: identical bodies take no part in matching by vector."""
    m = Tables(spark, sf_dir).documents.select("doc_id", F.md5(F.substring(F.col("text"), F.length(F.substring_index("text", "\n", 1)) + 1, F.length("text"))).alias("body"))
    n = m.groupBy("body").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "body").select("doc_id", (F.col("n") >= 2).alias("guarded"))


@query(
    "followup_links",
    f"""WITH {RECORDS}, {_SIMS}, s AS (SELECT a AS x, b AS y, sim AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims) WHERE n <= 4 AND sim >= 0.2)
    SELECT CASE WHEN (a.first_seen, a.event_id) <= (b.first_seen, b.event_id) THEN x ELSE y END AS from_id, CASE WHEN (a.first_seen, a.event_id) <= (b.first_seen, b.event_id) THEN y ELSE x END AS to_id, max(score) AS score FROM s JOIN records a ON a.event_id = x JOIN records b ON b.event_id = y GROUP BY 1, 2""",
)
def followup_links(spark, sf_dir):
    """MC12 MC13: a record's nearest neighbours over a floor, one link of a pair, from the earlier to the later."""
    t = Tables(spark, sf_dir)
    r = t.records.select("event_id", "first_seen")
    s = V.nearest(t.vectors, 4, digits=6).where(F.col("sim") >= 0.2).select(F.col("vec_id").alias("x"), F.col("nbr_id").alias("y"), F.col("sim").alias("score"))
    s = s.join(r.select(F.col("event_id").alias("x"), F.col("first_seen").alias("tx")), "x").join(r.select(F.col("event_id").alias("y"), F.col("first_seen").alias("ty")), "y")
    forward = F.struct(F.col("tx").alias("t"), F.col("x").alias("i")) <= F.struct(F.col("ty").alias("t"), F.col("y").alias("i"))
    return s.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("from_id"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("to_id"), "score").groupBy("from_id", "to_id").agg(F.max("score").alias("score"))


def _stars(pairs: str, nodes: str) -> str:
    """SQL of the star merge, one record after another in order of rank."""
    return f"""v AS ({pairs}), b AS (SELECT a AS x, b AS y FROM v UNION SELECT b, a FROM v), r AS (SELECT event_id, row_number() OVER (ORDER BY outlets DESC, told, event_id) AS n FROM ({nodes}) WHERE event_id IN (SELECT x FROM b)),
    near AS (SELECT o.n, o.event_id, coalesce(list(l.event_id ORDER BY l.event_id) FILTER (l.n > o.n), CAST([] AS BIGINT[])) AS ids FROM r o LEFT JOIN b ON b.x = o.event_id LEFT JOIN r l ON l.event_id = b.y GROUP BY o.n, o.event_id),
    turn AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS survivor, CAST([] AS BIGINT[]) AS fresh UNION ALL SELECT n, list_concat(taken, f), event_id, f FROM (SELECT near.n, taken, near.event_id,
      CASE WHEN list_contains(taken, near.event_id) THEN CAST([] AS BIGINT[]) ELSE list_filter(ids, lambda i: NOT list_contains(taken, i)) END AS f FROM turn JOIN near ON near.n = turn.n + 1))
    SELECT survivor, unnest(fresh) AS member FROM turn"""


@query("star_merges", f"WITH RECURSIVE {_EDGES}, {DOSSIER_NODES}, {_stars('SELECT a, b FROM edges', 'SELECT * FROM nodes')}")
def star_merges(spark, sf_dir):
    """MC15: members join a survivor only on their own verdict with it."""
    t = Tables(spark, sf_dir)
    return S.star_merge(_edges(t).select("a", "b"), t.dossier_nodes)


_COVERED = "SELECT * FROM nodes WHERE outlets >= 20 AND event_id IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 8)"


@query(
    "story_merge_plan",
    f"WITH RECURSIVE {_EDGES}, {DOSSIER_NODES}, covered AS ({_COVERED}), {_stars('SELECT a, b FROM edges WHERE shared >= 3 AND a IN (SELECT event_id FROM covered) AND b IN (SELECT event_id FROM covered)', 'SELECT * FROM covered')}",
)
def story_merge_plan(spark, sf_dir):
    """GR18: stories over the floors of outlets and developments merge along strong pairs, the better covered one stays."""
    t = Tables(spark, sf_dir)
    stories = t.records.groupBy(F.col("author_id").alias("event_id")).agg(F.count(F.lit(1)).alias("developments")).where(F.col("developments") >= 8)
    nodes = t.dossier_nodes.where(F.col("outlets") >= 20).join(stories.select("event_id"), "event_id", "left_semi")
    pairs = _edges(t).where(F.col("shared") >= 3)
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("event_id").alias(end)), end, "left_semi")
    return S.star_merge(pairs.select("a", "b"), nodes)


_ENTITIES = "n AS (SELECT p_partkey AS entity_id, p_type AS kind, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS key, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS ident FROM part)"
_FOLDS = f"""{_ENTITIES}, g AS (SELECT kind, key, count(DISTINCT ident) AS idents, min(entity_id) AS least FROM n GROUP BY kind, key), i AS (SELECT kind, key, ident, min(entity_id) AS least FROM n WHERE ident IS NOT NULL GROUP BY kind, key, ident),
  folds AS (SELECT n.entity_id, CASE WHEN g.idents <= 1 THEN g.least ELSE i.least END AS target, CASE WHEN g.idents <= 1 THEN 'name' ELSE 'identifier' END AS why FROM n JOIN g USING (kind, key) LEFT JOIN i ON i.kind = n.kind AND i.key = n.key AND i.ident = n.ident
    WHERE n.entity_id <> CASE WHEN g.idents <= 1 THEN g.least ELSE i.least END)"""


def _folds(t: Tables):
    key = F.array_join(F.array_sort(F.split(F.lower("name"), " ")), " ")
    named = t.actors.select("entity_id", "kind", key.alias("key"), F.when(F.col("size") % 3 != 0, F.col("brand")).alias("ident"))
    return S.entity_folds(named)


@query("entity_variants", f"WITH {_FOLDS} SELECT entity_id, target, why FROM folds")
def entity_variants(spark, sf_dir):
    """MC19 MC20: spellings of one kind that share a key are one entity, unless identifiers part them."""
    return _folds(Tables(spark, sf_dir))


@query(
    "entity_fold",
    f"""WITH {_FOLDS}, {MENTIONS}, j AS (SELECT event_id, m.entity_id AS old_id, coalesce(target, m.entity_id) AS new_id FROM mentions m LEFT JOIN folds f ON f.entity_id = m.entity_id)
    SELECT event_id, old_id, new_id, old_id > (SELECT min(x.old_id) FROM j x WHERE x.event_id = j.event_id AND x.new_id = j.new_id) AS dropped FROM j WHERE old_id <> new_id""",
)
def entity_fold(spark, sf_dir):
    """MC18: the journal of a fold: which mention moved where, and whether it met one there."""
    t = Tables(spark, sf_dir)
    return S.fold_entities(t.mentions, _folds(t))[1].select("event_id", "old_id", "new_id", "dropped")


@query("entity_restore", f"WITH {MENTIONS} SELECT event_id, entity_id FROM mentions")
def entity_restore(spark, sf_dir):
    """MC18: mentions folded and given back from the journal."""
    t = Tables(spark, sf_dir)
    folded, journal = S.fold_entities(t.mentions, _folds(t))
    return S.restore_entities(folded, journal)


@query("common_name_cut", f"WITH {MENTIONS}, n AS (SELECT count(DISTINCT event_id) AS n FROM mentions) SELECT p_name AS name, count(DISTINCT event_id) AS records FROM mentions JOIN part ON p_partkey = entity_id, n GROUP BY p_name HAVING count(DISTINCT event_id) > 0.05 * any_value(n.n)")
def common_name_cut(spark, sf_dir):
    """MC22: names in more than a share of all records."""
    t = Tables(spark, sf_dir)
    n = t.mentions.agg(F.countDistinct("event_id").alias("n"))
    c = t.mentions.join(t.actors.select("entity_id", "name"), "entity_id").groupBy("name").agg(F.countDistinct("event_id").alias("records")).join(F.broadcast(n))
    return c.where(F.col("records") > 0.05 * F.col("n")).select("name", "records")


@query(
    "clip_matching",
    f"""WITH {_SIMS}, c AS (SELECT a AS clip, b AS record, sim, b % 20 AS episode FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims) WHERE n <= 100), e AS (SELECT *, row_number() OVER (PARTITION BY clip, episode ORDER BY sim DESC, record) AS n FROM c WHERE sim >= 0.1)
    SELECT clip, record, CAST(k AS INTEGER) AS rnk, sim FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY sim DESC, record) AS k FROM e WHERE n = 1) WHERE k <= 4""",
)
def clip_matching(spark, sf_dir):
    """MC21 MC14 WN7: of a clip's hundred nearest those over a floor, one of each episode, four of each clip."""
    v = Tables(spark, sf_dir).vectors
    near = V.nearest(v, 100, digits=6).where(F.col("sim") >= 0.1).select(F.col("vec_id").alias("clip"), F.col("nbr_id").alias("record"), "sim")
    one = R.top_per_group(near.withColumn("episode", F.col("record") % 20), ["clip", "episode"], [F.desc("sim"), F.asc("record")], 1, "n")
    return R.top_per_group(one, ["clip"], [F.desc("sim"), F.asc("record")], 4).select("clip", "record", "rnk", "sim")


@query(
    "same_story",
    f"""WITH {RECORDS}, {MENTIONS}, s AS (SELECT author_id AS story, list(DISTINCT event_id) AS m, arg_max(event_id, (weight, event_id)) AS hero FROM records GROUP BY author_id), c AS (SELECT author_id AS story, list(DISTINCT entity_id) AS cast FROM records JOIN mentions USING (event_id) GROUP BY author_id)
    SELECT a.story AS a, b.story AS b, a.hero = b.hero OR len(list_intersect(ca.cast, cb.cast)) / CAST(least(len(ca.cast), len(cb.cast)) AS DOUBLE) >= 0.1 OR len(list_intersect(ca.cast, cb.cast)) / CAST(len(list_distinct(list_concat(ca.cast, cb.cast))) AS DOUBLE) >= 0.05 AS same
    FROM s a JOIN s b ON b.story = a.story + 1 JOIN c ca ON ca.story = a.story JOIN c cb ON cb.story = b.story""".replace(" AS cast", " AS crew").replace(".cast", ".crew"),
)
def same_story(spark, sf_dir):
    """GR14 GR13: one hero, or enough members or cast in common."""
    t = Tables(spark, sf_dir)
    heroes = t.records.groupBy(F.col("author_id").alias("story")).agg(F.max_by("event_id", F.struct("weight", "event_id")).alias("hero"))
    cast = t.records.select("event_id", F.col("author_id").alias("story")).join(t.mentions, "event_id").groupBy("story").agg(F.collect_set("entity_id").alias("cast"))
    s = heroes.join(cast, "story")
    a, b = s.select(F.col("story").alias("a"), F.col("hero").alias("ha"), F.col("cast").alias("ca")), s.select((F.col("story") - 1).alias("a"), F.col("story").alias("b"), F.col("hero").alias("hb"), F.col("cast").alias("cb"))
    same = (F.col("ha") == F.col("hb")) | (J.overlap(F.col("ca"), F.col("cb")) >= 0.1) | (J.jaccard(F.col("ca"), F.col("cb")) >= 0.05)
    return a.join(b, "a").select("a", "b", same.alias("same"))


@query(
    "story_reconciliation",
    f"""WITH {RECORDS}, o AS (SELECT author_id % 300 AS story, event_id FROM records WHERE first_seen < TIMESTAMP '2001-01-01'), n AS (SELECT author_id % 200 AS fresh, event_id FROM records WHERE first_seen < TIMESTAMP '2001-06-01' AND first_seen >= TIMESTAMP '2000-06-01'),
    h AS (SELECT fresh, count(DISTINCT story) AS hits, min(story) AS first_story FROM n LEFT JOIN o USING (event_id) GROUP BY fresh)
    SELECT fresh, CASE hits WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'merge' END AS action, first_story AS story FROM h""",
)
def story_reconciliation(spark, sf_dir):
    """GR15: new groups create, update or merge the stories their members had."""
    r = Tables(spark, sf_dir).records
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    old = r.where(F.col("first_seen") < at("2001-01-01")).select("event_id", (F.col("author_id") % 300).alias("story"))
    new = r.where((F.col("first_seen") < at("2001-06-01")) & (F.col("first_seen") >= at("2000-06-01"))).select("event_id", (F.col("author_id") % 200).alias("fresh"))
    h = new.join(old, "event_id", "left").groupBy("fresh").agg(F.countDistinct("story").alias("hits"), F.min("story").alias("story"))
    return h.select("fresh", F.when(F.col("hits") == 0, "create").when(F.col("hits") == 1, "update").otherwise("merge").alias("action"), "story")


@query(
    "story_refresh",
    f"""WITH {RECORDS}, {REPORTS}, s AS (SELECT author_id AS story, count(DISTINCT r.event_id) AS records, count(DISTINCT publisher) AS outlets, max(published_at) AS newest, count(DISTINCT publisher) FILTER (published_at > TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS velocity FROM records r JOIN reports p ON r.event_id = p.event_id GROUP BY author_id)
    SELECT story, records, outlets, velocity, records >= 2 AND outlets >= 2 AND newest > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY AS listed FROM s""",
)
def story_refresh(spark, sf_dir):
    """GR17: whether a story is listed, and its velocity by publication."""
    t = Tables(spark, sf_dir)
    rows = t.records.select("event_id", F.col("author_id").alias("story")).join(t.reports, "event_id")
    ago = lambda d: F.lit("2001-08-01").cast("timestamp_ntz") - F.expr(f"INTERVAL {d} DAYS")
    s = rows.groupBy("story").agg(
        F.countDistinct("event_id").alias("records"), F.countDistinct("publisher").alias("outlets"), F.max("published_at").alias("newest"),
        F.countDistinct(F.when(F.col("published_at") > ago(30), F.col("publisher"))).alias("velocity"),
    )
    return s.select("story", "records", "outlets", "velocity", ((F.col("records") >= 2) & (F.col("outlets") >= 2) & (F.col("newest") > ago(90))).alias("listed"))


@query(
    "related_records",
    f"""WITH {MENTIONS}, {_DF}, w AS (SELECT q.event_id, m.event_id AS other_id, round(sum(1.0 / df), 6) AS weight FROM mentions q JOIN mentions m ON q.entity_id = m.entity_id AND m.event_id <> q.event_id JOIN d ON d.entity_id = q.entity_id GROUP BY ALL)
    SELECT event_id, other_id, CAST(rnk AS INTEGER) AS rnk, weight FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, other_id) AS rnk FROM w WHERE weight >= 0.01) WHERE rnk <= 5""",
)
def related_records(spark, sf_dir):
    """GR20: the five records that share most rare actors with each asked one."""
    t = Tables(spark, sf_dir)
    return S.related(t.records, t.mentions, 0.01, 5).select("event_id", "other_id", "weight", "rnk")


@query(
    "story_timeline",
    f"""WITH {RECORDS}, {REPORTS}, f AS (SELECT event_id, min(published_at) AS told FROM reports GROUP BY event_id) SELECT author_id AS story, event_id, CAST(told AS TIMESTAMP) AS first_published, CAST(row_number() OVER (PARTITION BY author_id ORDER BY told, event_id) AS INTEGER) AS place,
      CASE WHEN event_id % 7 = 0 THEN 'because' END AS why FROM records JOIN f USING (event_id)""",
)
def story_timeline(spark, sf_dir):
    """GR21: a story's members by first publication, with a note where a link is strong."""
    t = Tables(spark, sf_dir)
    f = t.reports.groupBy("event_id").agg(F.min("published_at").alias("first_published"))
    w = Window.partitionBy("story").orderBy("first_published", "event_id")
    return t.records.select("event_id", F.col("author_id").alias("story")).join(f, "event_id").select("story", "event_id", "first_published", F.row_number().over(w).alias("place"), F.when(F.col("event_id") % 7 == 0, "because").alias("why"))


@query(
    "search_ilike",
    """SELECT p_partkey AS id, CASE WHEN p_name ILIKE '%small%' THEN 1 ELSE 2 END AS hit_tier, CAST(row_number() OVER (ORDER BY CASE WHEN p_name ILIKE '%small%' THEN 1 ELSE 2 END, p_partkey) AS INTEGER) AS rnk FROM part WHERE p_name ILIKE '%small%' OR p_type ILIKE '%small%' QUALIFY rnk <= 50""",
)
def search_ilike(spark, sf_dir):
    """SR1 FP16: title hits before other hits."""
    a = Tables(spark, sf_dir).actors
    name, kind = F.col("name").ilike("%small%"), F.col("kind").ilike("%small%")
    top = a.where(name | kind).select(F.col("entity_id").alias("id"), F.when(name, 1).otherwise(2).alias("hit_tier")).orderBy("hit_tier", "id").limit(50)
    return top.withColumn("rnk", F.row_number().over(Window.orderBy("hit_tier", "id")))


@query(
    "search_groups",
    f"""WITH {RECORDS} SELECT author_id AS story, count(*) AS n, CAST(max(first_seen) AS TIMESTAMP) AS best_at, arg_max(event_id, (first_seen, -event_id)) AS best FROM records WHERE sector = '1-URGENT' AND status = 'O' GROUP BY author_id HAVING count(*) >= 2""",
)
def search_groups(spark, sf_dir):
    """GR22: matches grouped by story, each group with its best match, by which callers order the groups."""
    m = Tables(spark, sf_dir).records.where((F.col("sector") == "1-URGENT") & (F.col("status") == "O"))
    best = F.max_by("event_id", F.struct("first_seen", (-F.col("event_id")).alias("i")))
    groups = m.groupBy(F.col("author_id").alias("story")).agg(F.count(F.lit(1)).alias("n"), F.max("first_seen").alias("best_at"), best.alias("best"))
    return groups.where(F.col("n") >= 2)


@query("verdict_reuse", f"WITH {RECORDS}, s AS (SELECT author_id AS story, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) || '|v1') AS signature FROM records GROUP BY author_id) SELECT story, signature FROM s WHERE substr(signature, 1, 1) NOT IN ('0', '1', '2', '3', '4')")
def verdict_reuse(spark, sf_dir):
    """GR24 GR23: only signatures that were never judged are asked."""
    r = Tables(spark, sf_dir).records
    s = r.groupBy(F.col("author_id").alias("story")).agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ","), F.lit("|v1")), 256).alias("signature"))
    judged = s.where(F.substring("signature", 1, 1) <= "4").select("signature")
    return s.join(judged, "signature", "left_anti").select("story", "signature")


@query(
    "record_dedup",
    "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
)
def record_dedup(spark, sf_dir):
    """QC10 WN2: one document of each opening per record."""
    d = Tables(spark, sf_dir).documents.withColumn("k", F.md5("text"))
    return R.top_per_group(d, ["source", "k"], [F.asc("doc_id")], 1).select("source", "doc_id", "lang")


@query(
    "quotes_by_speaker",
    "SELECT role AS speaker, count(*) AS quotes, count(DISTINCT conv_id) AS records, mode(CAST(turn % 2 AS INTEGER)) AS side FROM conversations WHERE role <> 'system' GROUP BY role HAVING count(DISTINCT conv_id) >= 2",
)
def quotes_by_speaker(spark, sf_dir):
    """QC11 QC14: speakers with their quotes, records and usual side."""
    c = Tables(spark, sf_dir).raw("conversations").where(F.col("role") != "system")
    return c.groupBy(F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("quotes"), F.countDistinct("conv_id").alias("records"), F.mode((F.col("turn") % 2).cast("int")).alias("side")).where(F.col("records") >= 2)


@query("card_hashes", "SELECT conv_id, sha1(string_agg(md5(text), ',' ORDER BY md5(text))) AS card, count(*) AS quotes FROM conversations GROUP BY conv_id")
def card_hashes(spark, sf_dir):
    """QC13: the hash of a record's sorted quotes."""
    c = Tables(spark, sf_dir).raw("conversations")
    return c.groupBy("conv_id").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.md5("text"))), ",")).alias("card"), F.count(F.lit(1)).alias("quotes"))
