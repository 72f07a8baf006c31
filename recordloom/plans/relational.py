"""Joins, aggregates, windows and set operations on the bound relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.operators import relations as J
from recordloom.operators import stories as S
from recordloom.operators import vectors as V
from recordloom.plans.bind import MENTIONS, RECORDS, REPORTS, Tables
from recordloom.plans.registry import query


@query(
    "entity_df_idf",
    f"WITH {MENTIONS}, n AS (SELECT count(DISTINCT event_id) AS n FROM mentions) SELECT entity_id, count(*) AS df, round(1.0 / count(*), 6) AS inv_df, round(ln(any_value(n) / (1.0 + count(*))), 6) AS log_idf FROM mentions, n GROUP BY entity_id",
)
def entity_df_idf(spark, sf_dir):
    """AG1 AG2: document frequency, its inverse and its logarithm."""
    mentions = Tables(spark, sf_dir).mentions
    n = mentions.agg(F.countDistinct("event_id").alias("n"))
    df = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    return df.select("entity_id", "df", F.round(1.0 / F.col("df"), 6).alias("inv_df"), F.round(F.log(F.col("n") / (1.0 + F.col("df"))), 6).alias("log_idf"))


@query(
    "weighted_shared_actors",
    f"""WITH {MENTIONS}, d AS (SELECT entity_id, count(*) AS df FROM mentions GROUP BY entity_id), q AS (SELECT * FROM mentions)
    SELECT q.event_id AS a, m.event_id AS b, count(*) AS shared, round(sum(1.0 / df), 6) AS weight, round(max(1.0 / df), 6) AS rarest
    FROM q JOIN mentions m ON q.entity_id = m.entity_id AND q.event_id <> m.event_id JOIN d ON d.entity_id = q.entity_id
    GROUP BY q.event_id, m.event_id HAVING count(*) >= 2 AND (max(1.0 / df) >= 0.02 OR count(*) >= 4)""",
)
def weighted_shared_actors(spark, sf_dir):
    """AG3 JN7: shared actors weighted by rarity, each pair made once and then given both ways."""
    keep = (F.col("shared") >= 2) & ((F.col("rarest") >= 0.02) | (F.col("shared") >= 4))
    pairs = S.shared_actors(Tables(spark, sf_dir).mentions, keep, 2, hub_shared=4)
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    return pairs.select(ends, "shared", "weight", "rarest").select("p.a", "p.b", "shared", F.round("weight", 6).alias("weight"), F.round("rarest", 6).alias("rarest"))


@query(
    "own_cast",
    f"""WITH {REPORTS}, n AS (SELECT event_id, count(DISTINCT source_id) AS sources FROM reports GROUP BY event_id),
    e AS (SELECT event_id, entity_id, count(DISTINCT source_id) AS named_by FROM reports GROUP BY event_id, entity_id)
    SELECT e.event_id, e.entity_id, named_by FROM e JOIN n ON e.event_id = n.event_id WHERE named_by >= 2 OR sources = 1""",
)
def own_cast(spark, sf_dir):
    """AG4: actors that two reports name; a record with one report is exempt."""
    reports = Tables(spark, sf_dir).reports
    sources = reports.groupBy("event_id").agg(F.countDistinct("source_id").alias("sources"))
    named = reports.groupBy("event_id", "entity_id").agg(F.countDistinct("source_id").alias("named_by"))
    return named.join(sources, "event_id").where((F.col("named_by") >= 2) | (F.col("sources") == 1)).select("event_id", "entity_id", "named_by")


@query(
    "coverage_links",
    f"""WITH {REPORTS}, p AS (SELECT DISTINCT event_id, source_id FROM reports), k AS (SELECT source_id FROM p GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 120), t AS (SELECT * FROM p WHERE source_id IN (SELECT source_id FROM k))
    SELECT x.source_id AS a, y.source_id AS b, count(*) AS shared FROM t x JOIN t y ON x.event_id = y.event_id AND x.source_id < y.source_id GROUP BY ALL""",
)
def coverage_links(spark, sf_dir):
    """JN3 RP10: records that two of the 120 largest outlets both reported."""
    pairs = Tables(spark, sf_dir).reports.select("event_id", "source_id").distinct()
    return J.co_occurrence(pairs, "event_id", "source_id", top=120, salt=4)


@query(
    "language_pairs",
    f"WITH {REPORTS}, p AS (SELECT DISTINCT event_id, publisher FROM reports) SELECT x.publisher AS a, y.publisher AS b, count(*) AS stories FROM p x JOIN p y ON x.event_id = y.event_id AND x.publisher < y.publisher GROUP BY ALL",
)
def language_pairs(spark, sf_dir):
    """JN4 RP10: records in both of two languages (nations here)."""
    pairs = Tables(spark, sf_dir).reports.select("event_id", "publisher").distinct()
    return J.co_occurrence(pairs, "event_id", "publisher").withColumnRenamed("shared", "stories")


@query("orphan_records", f"WITH {RECORDS} SELECT event_id, sector FROM records WHERE event_id NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_records(spark, sf_dir):
    """JN5 SS7: records without any report."""
    t = Tables(spark, sf_dir)
    return t.records.join(t.raw("lineitem").select(F.col("l_orderkey").alias("event_id")), "event_id", "left_anti").select("event_id", "sector")


@query(
    "no_twin_rows",
    f"WITH {REPORTS} SELECT DISTINCT a.event_id, a.source_id, a.entity_id FROM reports a WHERE flag = 'A' AND NOT EXISTS (SELECT 1 FROM reports b WHERE b.flag = 'R' AND a.event_id = b.event_id AND a.source_id = b.source_id)",
)
def no_twin_rows(spark, sf_dir):
    """JN6: rows without a twin on a composite key."""
    r = Tables(spark, sf_dir).reports
    twin = r.where(F.col("flag") == "R").select("event_id", "source_id")
    return r.where(F.col("flag") == "A").join(twin, ["event_id", "source_id"], "left_anti").select("event_id", "source_id", "entity_id").distinct()


@query("has_claims", f"WITH {RECORDS} SELECT event_id FROM records WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = event_id AND l_returnflag = 'R')")
def has_claims(spark, sf_dir):
    """JN7: records with at least one row of a kind."""
    t = Tables(spark, sf_dir)
    claims = t.raw("lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("event_id"))
    return t.records.select("event_id").join(claims, "event_id", "left_semi")


@query(
    "array_membership",
    f"""WITH {RECORDS}, s AS (SELECT author_id AS story, list(event_id ORDER BY event_id) AS members FROM records GROUP BY author_id)
    SELECT event_id, story, len(members) AS n_members FROM (SELECT story, members, unnest(members) AS event_id FROM s)""",
)
def array_membership(spark, sf_dir):
    """JN18 JN10: the story whose member array holds a record, by explode and hash join."""
    rows = Tables(spark, sf_dir).records
    stories = rows.groupBy(F.col("author_id").alias("story")).agg(F.array_sort(F.collect_list("event_id")).alias("members"))
    asked = rows.select("event_id")
    held = stories.select("story", F.size("members").cast("long").alias("n_members"), F.explode("members").alias("event_id"))
    return held.join(asked, "event_id", "left_semi").select("event_id", "story", "n_members")


@query("zip_probe", f"WITH {RECORDS}, z AS (SELECT unnest([1, 2, 3]) AS a, unnest(['O', 'F', 'P']) AS s) SELECT event_id, a, status FROM records JOIN z ON status = s AND CAST(substr(sector, 1, 1) AS INTEGER) = a")
def zip_probe(spark, sf_dir):
    """JN20: pairs zipped from two arrays, joined to rows."""
    z = spark.range(1).select(F.explode(F.arrays_zip(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("a"), F.array(F.lit("O"), F.lit("F"), F.lit("P")).alias("s"))).alias("z")).select("z.a", "z.s")
    return Tables(spark, sf_dir).records.join(F.broadcast(z), (F.col("status") == F.col("s")) & (F.substring("sector", 1, 1).cast("int") == F.col("a"))).select("event_id", "a", "status")


_LINKS = "links AS (SELECT o_orderkey AS id, o_orderkey // 2 AS target FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 0)"


@query(
    "merge_chain_root",
    f"""WITH RECURSIVE {_LINKS}, w AS (SELECT id, target AS root, 1 AS hops FROM links UNION ALL SELECT w.id, l.target, hops + 1 FROM w JOIN links l ON w.root = l.id WHERE hops < 8)
    SELECT id, root, CAST(hops AS INTEGER) AS hops FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS n FROM w) WHERE n = 1""",
)
def merge_chain_root(spark, sf_dir):
    """JN12 JN13 MC17: where a chain of redirects ends."""
    o = Tables(spark, sf_dir).raw("orders").where((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") > 0))
    return J.redirect_roots(o.select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 2").alias("target")))


@query(
    "redirect_one_hop",
    f"WITH {_LINKS}, {MENTIONS} SELECT DISTINCT coalesce(target, event_id) AS event_id, entity_id FROM mentions LEFT JOIN links ON event_id = id",
)
def redirect_one_hop(spark, sf_dir):
    """JN11 MC16 MC18: mentions repointed through one redirect; twins collapse."""
    t = Tables(spark, sf_dir)
    links = t.raw("orders").where((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") > 0)).select(F.col("o_orderkey").alias("id"), F.expr("o_orderkey div 2").alias("target"))
    return t.mentions.join(links, F.col("event_id") == F.col("id"), "left").select(F.coalesce("target", "event_id").alias("event_id"), "entity_id").distinct()


@query(
    "time_band_pairs",
    f"""WITH {RECORDS} SELECT a.event_id AS a, b.event_id AS b FROM records a JOIN records b ON a.author_id = b.author_id AND a.event_id < b.event_id
    AND abs(epoch_us(a.first_seen) - epoch_us(b.first_seen)) <= 14 * 86400000000""",
)
def time_band_pairs(spark, sf_dir):
    """JN14: records of one author within 14 days, by bucketed equi-join."""
    rows = Tables(spark, sf_dir).records
    a = rows.select("author_id", F.col("event_id").alias("a"), F.col("first_seen").alias("ta"))
    b = rows.select("author_id", F.col("event_id").alias("b"), F.col("first_seen").alias("tb"))
    return J.band_join(a, b, ["author_id"], "ta", "tb", 14 * 86400).where(F.col("a") < F.col("b")).select("a", "b")


@query(
    "as_of_value",
    """SELECT p.event_id, s.event_id AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') s ON p.user_id = s.user_id AND p.ts >= s.ts""",
)
def as_of_value(spark, sf_dir):
    """JN15: the last click at or before each purchase of the same user."""
    e = Tables(spark, sf_dir).clocks
    left = e.where(F.col("event_type") == "purchase").select("user_id", "event_id", "ts")
    right = e.where(F.col("event_type") == "click").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    return J.as_of_join(left, right, "user_id", "ts", "at", "click", "click").select("event_id", "as_of_value")


@query(
    "touching_links",
    f"WITH {RECORDS}, l AS (SELECT event_id AS src, event_id // 3 AS dst FROM records) SELECT DISTINCT src, dst FROM l WHERE src IN (SELECT event_id FROM records WHERE status = 'P') OR dst IN (SELECT event_id FROM records WHERE status = 'P')",
)
def touching_links(spark, sf_dir):
    """JN17: links that touch a set on either side, as two equi-joins."""
    rows = Tables(spark, sf_dir).records
    links = rows.select(F.col("event_id").alias("src"), F.expr("event_id div 3").alias("dst"))
    nodes = rows.where(F.col("status") == "P").select(F.col("event_id").alias("node"))
    return J.touching(links, nodes, "src", "dst", "node")


@query(
    "majority_assignment",
    f"""WITH {RECORDS}, o AS (SELECT author_id AS old, count(*) AS size FROM records GROUP BY author_id), k AS (SELECT author_id AS old, sector AS new, count(*) AS k FROM records GROUP BY ALL)
    SELECT old, new, k, size FROM (SELECT k.*, size, row_number() OVER (PARTITION BY k.old ORDER BY k DESC, new) AS n FROM k JOIN o ON k.old = o.old) WHERE n = 1 AND k * 2 >= size""",
)
def majority_assignment(spark, sf_dir):
    """JN19: an old group maps to the new one that holds at least half of it."""
    rows = Tables(spark, sf_dir).records
    k = rows.groupBy(F.col("author_id").alias("old"), F.col("sector").alias("new")).agg(F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy("old")
    k = k.withColumn("size", F.sum("k").over(own)).withColumn("n", F.row_number().over(own.orderBy(F.desc("k"), "new")))
    return k.where((F.col("n") == 1) & (F.col("k") * 2 >= F.col("size"))).select("old", "new", "k", "size")


@query(
    "recurring_cast",
    f"""WITH {RECORDS}, m AS (SELECT DISTINCT author_id AS story, l_orderkey AS event_id, p_name AS name FROM lineitem JOIN records ON l_orderkey = event_id JOIN part ON l_partkey = p_partkey)
    SELECT story, name, n FROM (SELECT story, name, count(*) AS n, row_number() OVER (PARTITION BY story ORDER BY count(*) DESC, name) AS k FROM m GROUP BY story, name HAVING count(*) >= 2) WHERE k <= 8""",
)
def recurring_cast(spark, sf_dir):
    """AG15: names on two records of a story or more, the eight most frequent."""
    t = Tables(spark, sf_dir)
    named = t.mentions.join(t.actors.select("entity_id", "name"), "entity_id").join(t.records.select("event_id", F.col("author_id").alias("story")), "event_id").select("story", "event_id", "name").distinct()
    counted = named.groupBy("story", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("n"), "name"))).where(F.col("k") <= 8).select("story", "name", "n")


@query(
    "subject_rollup",
    """WITH p AS (SELECT p_partkey, p_type || '.' || p_brand || '.' || CAST(p_size AS VARCHAR) AS path FROM part)
    SELECT array_to_string(list_slice(string_split(path, '.'), 1, n), '.') AS path, count(*) AS n FROM p, generate_series(1, 3) g(n) GROUP BY 1""",
)
def subject_rollup(spark, sf_dir):
    """AG16 FP4 RP16: every leaf counted on each ancestor path."""
    a = Tables(spark, sf_dir).actors.select(F.concat_ws(".", "kind", "brand", F.col("size").cast("string")).alias("path"))
    return a.select(F.explode(J.ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("subject_prefix", "SELECT p_partkey AS entity_id FROM part WHERE p_type || '.' || p_brand = 'PROMO.Brand#1' OR p_type || '.' || p_brand LIKE 'PROMO.Brand#1.%' OR p_type = 'SMALL'")
def subject_prefix(spark, sf_dir):
    """FP4: a path itself or anything below it."""
    path = F.concat_ws(".", "kind", "brand")
    under = lambda p: (path == p) | path.startswith(p + ".")
    return Tables(spark, sf_dir).actors.where(under("PROMO.Brand#1") | under("SMALL")).select("entity_id")


@query(
    "ordered_names",
    f"""WITH {MENTIONS}, d AS (SELECT entity_id, count(*) AS df FROM mentions GROUP BY entity_id)
    SELECT event_id, string_agg(p_name, ',' ORDER BY df, p_name, m.entity_id) AS names FROM mentions m JOIN d ON m.entity_id = d.entity_id JOIN part ON p_partkey = m.entity_id GROUP BY event_id""",
)
def ordered_names(spark, sf_dir):
    """AG23: names aggregated in order of rarity."""
    t = Tables(spark, sf_dir)
    df = t.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("df"))
    rows = t.mentions.join(df, "entity_id").join(t.actors.select("entity_id", "name"), "entity_id")
    listed = rows.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("df", "name", "entity_id"))).alias("l"))
    return listed.select("event_id", F.array_join("l.name", ",").alias("names"))


@query(
    "candidate_union",
    f"""WITH {RECORDS}, u AS (SELECT event_id, 1 AS tier FROM records WHERE status = 'O' AND weight > 400000 UNION ALL SELECT event_id, 2 FROM records WHERE sector = '1-URGENT' AND weight > 300000 UNION ALL SELECT event_id, 3 FROM records WHERE status = 'P')
    SELECT event_id, min(tier) AS tier FROM u GROUP BY event_id ORDER BY tier, event_id LIMIT 500""",
)
def candidate_union(spark, sf_dir):
    """ST2 ST3: candidates of three branches, first seen wins, capped."""
    r = Tables(spark, sf_dir).records
    tier = lambda cond, n: r.where(cond).select("event_id", F.lit(n).alias("tier"))
    w = F.col("weight")
    every = tier((F.col("status") == "O") & (w > 400000), 1).unionByName(tier((F.col("sector") == "1-URGENT") & (w > 300000), 2)).unionByName(tier(F.col("status") == "P", 3))
    return every.groupBy("event_id").agg(F.min("tier").alias("tier")).orderBy("tier", "event_id").limit(500)


@query("union_distinct_keys", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def union_distinct_keys(spark, sf_dir):
    """ST1: the distinct union of two key sets."""
    t = Tables(spark, sf_dir)
    a = t.raw("customer").where(F.col("c_acctbal") > 9900).select(F.col("c_nationkey").alias("nation"))
    return a.union(t.raw("supplier").where(F.col("s_acctbal") > 9000).select("s_nationkey")).distinct()


@query("undirected_pairs", f"WITH {RECORDS} SELECT DISTINCT least(event_id, event_id * 7 % 1000) AS a, greatest(event_id, event_id * 7 % 1000) AS b FROM records WHERE event_id <> event_id * 7 % 1000")
def undirected_pairs(spark, sf_dir):
    """ST4: pairs normalised and distinct."""
    return J.undirected(Tables(spark, sf_dir).records.select("event_id", (F.col("event_id") * 7 % 1000).alias("other")), "event_id", "other")


@query(
    "set_overlap",
    f"""WITH {REPORTS}, s AS (SELECT event_id, list(DISTINCT publisher) AS p FROM reports GROUP BY event_id), {RECORDS}, k AS (SELECT s.*, author_id AS g FROM s JOIN records USING (event_id))
    SELECT a.event_id AS a, b.event_id AS b, round(len(list_intersect(a.p, b.p)) / CAST(least(len(a.p), len(b.p)) AS DOUBLE), 6) AS overlap,
      round(len(list_intersect(a.p, b.p)) / CAST(len(list_distinct(list_concat(a.p, b.p))) AS DOUBLE), 6) AS jaccard FROM k a JOIN k b ON a.g = b.g AND a.event_id < b.event_id""",
)
def set_overlap(spark, sf_dir):
    """ST5: overlap coefficient and Jaccard similarity of the outlets of two records of one author."""
    t = Tables(spark, sf_dir)
    s = t.reports.groupBy("event_id").agg(F.collect_set("publisher").alias("p")).join(t.records.select("event_id", F.col("author_id").alias("g")), "event_id")
    a, b = s.select("g", F.col("event_id").alias("a"), F.col("p").alias("pa")), s.select("g", F.col("event_id").alias("b"), F.col("p").alias("pb"))
    pair = a.join(b, "g").where(F.col("a") < F.col("b"))
    return pair.select("a", "b", F.round(J.overlap(F.col("pa"), F.col("pb")), 6).alias("overlap"), F.round(J.jaccard(F.col("pa"), F.col("pb")), 6).alias("jaccard"))


@query(
    "placeholder_images",
    """WITH k AS (SELECT l_suppkey AS image FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 620 UNION SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 600)
    SELECT s_suppkey AS image, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT image FROM k)""",
)
def placeholder_images(spark, sf_dir):
    """FP10 ST1: images repeated too often by either measure are dropped."""
    t = Tables(spark, sf_dir)
    by = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("image")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("d"))
    bad = by.where(F.col("n") >= 620).select("image").union(by.where(F.col("d") >= 600).select("image")).distinct()
    return t.raw("supplier").select(F.col("s_suppkey").alias("image"), F.col("s_name").alias("name")).join(bad, "image", "left_anti")


@query("stop_entities", f"WITH {MENTIONS} SELECT event_id, count(*) AS n FROM mentions JOIN part ON p_partkey = entity_id WHERE p_name NOT IN ('small ring', 'red widget', 'blue bolt') GROUP BY event_id")
def stop_entities(spark, sf_dir):
    """FP8 FP9: fixed and derived names that never count as actors."""
    t = Tables(spark, sf_dir)
    stop = spark.createDataFrame([("small ring",), ("red widget",), ("blue bolt",)], "name string")
    actors = t.actors.select("entity_id", "name").join(F.broadcast(stop), "name", "left_anti").select("entity_id")
    return t.mentions.join(actors, "entity_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "roundup_exclusion",
    f"WITH {MENTIONS}, b AS (SELECT event_id FROM mentions GROUP BY event_id HAVING count(*) >= 8) SELECT o_orderkey AS event_id FROM orders WHERE NOT (regexp_matches(o_orderpriority, '^[12]-') AND o_orderkey IN (SELECT event_id FROM b))",
)
def roundup_exclusion(spark, sf_dir):
    """FP7: a title pattern together with many actors marks a round-up."""
    t = Tables(spark, sf_dir)
    many = t.mentions.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 8)
    bad = t.records.where(F.col("sector").rlike("^[12]-")).join(many, "event_id", "left_semi").select("event_id")
    return t.records.select("event_id").join(bad, "event_id", "left_anti")


@query(
    "raw_dedup",
    "SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents",
)
def raw_dedup(spark, sf_dir):
    """SC4 SC3: the same text again within one publisher."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "source", F.md5("text").alias("m"))
    return d.withColumn("is_duplicate", F.row_number().over(Window.partitionBy("source", "m").orderBy("doc_id")) > 1).select("doc_id", "source", "is_duplicate")


@query("exact_duplicate_groups", "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    """JN2 AG25: texts that occur more than once."""
    d = Tables(spark, sf_dir).documents
    return d.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > 1)


@query("language_override", "SELECT doc_id, coalesce(CASE WHEN source IN ('src1', 'src2') THEN 'xx' END, lang) AS lang FROM documents")
def language_override(spark, sf_dir):
    """SC5: the source's language beats the collector's."""
    over = spark.createDataFrame([("src1", "xx"), ("src2", "xx")], "source string, own string")
    return Tables(spark, sf_dir).documents.join(F.broadcast(over), "source", "left").select("doc_id", F.coalesce("own", "lang").alias("lang"))


@query("idempotent_insert", f"WITH {RECORDS} SELECT event_id, sector FROM records WHERE sector <> '5-LOW' AND event_id NOT IN (SELECT event_id FROM records WHERE status = 'F')")
def idempotent_insert(spark, sf_dir):
    """SC3: rows that are not in the target yet."""
    r = Tables(spark, sf_dir).records
    return r.where(F.col("sector") != "5-LOW").join(r.where(F.col("status") == "F").select("event_id"), "event_id", "left_anti").select("event_id", "sector")


@query("json_payload", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_payload(spark, sf_dir):
    """SC8 DM9: a payload written as JSON and a key read from one."""
    e = Tables(spark, sf_dir).clocks
    return e.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("payload"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("rollup_cube", "SELECT o_orderpriority AS sector, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_cube(spark, sf_dir):
    """AG26: grouping sets."""
    return Tables(spark, sf_dir).records.rollup("sector", "status").agg(F.count(F.lit(1)).alias("n"))


@query("except_intersect", "(SELECT s_nationkey AS n FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL (SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def except_intersect(spark, sf_dir):
    """ST7: EXCEPT and INTERSECT."""
    t = Tables(spark, sf_dir)
    s = t.raw("supplier").select(F.col("s_nationkey").alias("n"))
    rich = t.raw("customer").where(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("n"))
    asia = t.raw("nation").where(F.col("n_regionkey") == 1).select(F.col("n_nationkey").alias("n"))
    return s.subtract(rich).unionAll(s.intersect(asia))


@query(
    "frame_functions",
    """SELECT event_id, lag(value) OVER w AS prev_value, lead(event_id) OVER w AS next_id, CAST(ntile(4) OVER w AS INTEGER) AS quartile, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS kind_rank,
      round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def frame_functions(spark, sf_dir):
    """WN17: lag, lead, ntile, ranks and a row frame."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return Tables(spark, sf_dir).clocks.select(
        "event_id", F.lag("value").over(w).alias("prev_value"), F.lead("event_id").over(w).alias("next_id"), F.ntile(4).over(w).alias("quartile"),
        F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).alias("kind_rank"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("moving"),
    )


@query("approximate_counts", "SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS users_close, TRUE AS median_close FROM events GROUP BY event_type")
def approximate_counts(spark, sf_dir):
    """AG27: sketched counts and quantiles, told against the exact ones."""
    e = Tables(spark, sf_dir).clocks
    rows = e.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("near"), F.percentile_approx("value", 0.5).alias("middle"), F.countDistinct("user_id").alias("users"),
        F.percentile("value", 0.48).alias("low"), F.percentile("value", 0.52).alias("high"),
    )
    return rows.select("event_type", "users", (F.abs(F.col("near") - F.col("users")) <= 0.06 * F.col("users")).alias("users_close"), F.col("middle").between(F.col("low"), F.col("high")).alias("median_close"))


@query(
    "vector_average",
    """WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), a AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, i)
    SELECT label, CAST(i AS INTEGER) AS i, round(m, 6) AS m FROM a""",
)
def vector_average(spark, sf_dir):
    """AG21 GR16: the centroid of each label."""
    centres = V.centroids(Tables(spark, sf_dir).vectors, "label", "embedding")
    return centres.select("label", F.posexplode("centroid").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))
