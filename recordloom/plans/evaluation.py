"""Scoring of clusters and rules, audits, drifting payloads, sinks and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.functions import tables
from recordloom.functions import unicode as U
from recordloom.operators import records as R
from recordloom.operators import stories as S
from recordloom.operators import vectors as V
from recordloom.operators.sparse import cosine_classes
from recordloom.plans import stories as plans
from recordloom.plans import texts
from recordloom.plans.bind import RECORDS, Tables
from recordloom.plans.registry import ORACLES, query
from recordloom.sources import files
from recordloom.storage import scratch_root
from recordloom.streaming import pipeline as P


@query(
    "pair_confusion",
    f"""WITH {plans._CENTRE}, p AS (SELECT vec_id, label, gold FROM near WHERE k = 1 AND dist <= 0.75), g AS (SELECT vec_id, label AS gold FROM embeddings), pairs AS (
      SELECT pa.label = pb.label AS predicted, a.gold = b.gold AS same, pa.label IS NOT NULL AND pb.label IS NOT NULL AS covered FROM g a JOIN g b ON a.vec_id < b.vec_id LEFT JOIN p pa ON pa.vec_id = a.vec_id LEFT JOIN p pb ON pb.vec_id = b.vec_id)
    SELECT count(*) FILTER (covered AND predicted AND same) AS tp, count(*) FILTER (covered AND predicted AND NOT same) AS fp, count(*) FILTER (covered AND NOT predicted AND same) AS fn, count(*) FILTER (covered AND NOT predicted AND NOT same) AS tn, round(count(*) FILTER (covered) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM pairs""",
)
def pair_confusion(spark, sf_dir):
    """EV4: outcomes of all pairs, from group sizes alone, with the share of pairs that the prediction covers."""
    every = plans._nearest_centroid(Tables(spark, sf_dir))
    held = every.where(F.col("dist") <= 0.75)
    two = lambda n: n * (n - 1) / 2

    def pairs(df, name, *keys):
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
        return sizes.agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0)).cast("long").alias(name))

    counts = pairs(held, "tp", "label", "gold")
    for other in (pairs(held, "hit", "label"), pairs(held, "same", "gold"), pairs(held, "covered"), pairs(every, "all")):
        counts = counts.join(F.broadcast(other))  # one row each
    tp, hit, same = F.col("tp"), F.col("hit"), F.col("same")
    return counts.select("tp", (hit - tp).alias("fp"), (same - tp).alias("fn"), (F.col("covered") - hit - same + tp).alias("tn"), F.round(F.col("covered") / F.col("all"), 6).alias("coverage"))


@query(
    "percentile_mapping",
    f"""WITH {plans._UNIT}, p AS (SELECT round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 3) AS x, round(list_cosine_similarity(a.v, b.v), 3) AS y FROM u a JOIN u b ON a.vec_id < b.vec_id),
    g AS (SELECT CAST(t AS DOUBLE) AS threshold, (SELECT count(*) FROM p WHERE x <= t) AS n FROM (VALUES (0.0), (0.1), (0.2), (0.3)) v(t)), r AS (SELECT y, row_number() OVER (ORDER BY y) AS n FROM p)
    SELECT threshold, g.n AS below, y AS mapped FROM g JOIN r ON r.n = g.n""",
)
def percentile_mapping(spark, sf_dir):
    """EV7: thresholds of one model as the equal percentiles of another, from counts per rounded score."""
    v = Tables(spark, sf_dir).vectors
    first, second = V.similarity_counts(v, "label", dims=32), V.similarity_counts(v, "label")
    grid = first.select("sim", "n", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3)))).alias("threshold"))
    below = grid.groupBy("threshold").agg(plans._n(F.col("sim") <= F.col("threshold") + 1e-9).alias("below"))
    ranked = second.groupBy(F.col("sim").alias("y")).agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, 0)))
    return below.join(ranked, (F.col("below") <= F.col("upto")) & (F.col("below") > F.col("upto") - F.col("n"))).select("threshold", "below", F.col("y").alias("mapped"))


@query(
    "rule_comparison",
    f"""WITH {plans._PAIRS} SELECT rule, count(*) FILTER (same) AS tp, count(*) FILTER (NOT same) AS fp FROM (SELECT 'strict' AS rule, same FROM p WHERE sim >= 0.25 UNION ALL SELECT 'loose', same FROM p WHERE sim >= 0.15) GROUP BY rule""",
)
def rule_comparison(spark, sf_dir):
    """EV8: two candidate rules scored on the same pairs."""
    sim = F.col("sim") + 1e-9
    rules = F.array_compact(F.array(F.when(sim >= 0.25, "strict"), F.when(sim >= 0.15, "loose")))
    p = plans._label_pairs(Tables(spark, sf_dir)).select("same", "n", F.explode(rules).alias("rule"))
    return p.groupBy("rule").agg(plans._n(F.col("same")).alias("tp"), plans._n(~F.col("same")).alias("fp"))


@query(
    "split_and_fused",
    f"""WITH {plans._CENTRE}, n AS (SELECT label, gold FROM near WHERE k = 1) SELECT 'split' AS kind, gold AS grp, count(DISTINCT label) AS parts, count(*) AS size FROM n GROUP BY gold HAVING count(DISTINCT label) > 1 UNION ALL SELECT 'fused', label, count(DISTINCT gold), count(*) FROM n GROUP BY label HAVING count(DISTINCT gold) > 1""",
)
def split_and_fused(spark, sf_dir):
    """EV9: gold groups that were split, clusters that fuse several, with sizes."""
    n = plans._nearest_centroid(Tables(spark, sf_dir))
    side = lambda kind, by, other: n.groupBy(F.col(by).alias("grp")).agg(F.countDistinct(other).alias("parts"), F.count(F.lit(1)).alias("size")).where(F.col("parts") > 1).withColumn("kind", F.lit(kind))
    return side("split", "gold", "label").unionByName(side("fused", "label", "gold")).select("kind", "grp", "parts", "size")


@query(
    "exact_set_marking",
    """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-03')) AS a, list_sort(list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-28')) AS b FROM events GROUP BY user_id), t AS (SELECT array_to_string(coalesce(a, []), ',') AS a, array_to_string(coalesce(b, []), ',') AS b FROM s),
    c AS (SELECT max(n) AS best FROM (SELECT a, count(*) AS n FROM t GROUP BY a)) SELECT count(*) AS tasks, count(*) FILTER (a = b) AS exact, any_value(best) AS constant_best FROM t, c""",
)
def exact_set_marking(spark, sf_dir):
    """EV11: answers marked as whole sets, beside the best constant answer."""
    e = Tables(spark, sf_dir).clocks
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    chosen = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("event_type")))), ",")
    t = e.groupBy("user_id").agg(chosen(F.col("ts") < at("2024-01-03")).alias("a"), chosen(F.col("ts") >= at("2024-01-28")).alias("b"))
    best = t.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("constant_best"))
    return t.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("a") == F.col("b")).alias("exact")).join(F.broadcast(best))


@query(
    "candidate_recall",
    f"""WITH {plans._SIMS}, k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims), x AS (SELECT s.a, s.b, ('0x' || substr(md5('fold:' || s.a), 1, 4))::BIGINT % 5 AS fold, k.n <= 20 AS found FROM sims s JOIN k ON k.a = s.a AND k.b = s.b WHERE s.la = s.lb)
    SELECT fold, count(*) AS gold, count(*) FILTER (found) AS found FROM x GROUP BY fold""",
)
def candidate_recall(spark, sf_dir):
    """EV13: per fold, how many gold pairs are among each vector's twenty nearest."""
    v = Tables(spark, sf_dir).vectors
    fold = lambda c: (F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col(c).cast("string"))), 1, 4), 16, 10).cast("long") % 5).alias("fold")
    # a vector's gold pairs are all of its label but itself: counted, never made
    own = v.where(F.col("label").isNotNull()).groupBy("label", "vec_id").agg(F.count(F.lit(1)).alias("own"))
    gold = own.join(own.groupBy("label").agg(F.sum("own").alias("all")), "label").where(F.col("all") > F.col("own"))
    gold = gold.groupBy(fold("vec_id")).agg(F.sum(F.col("own") * (F.col("all") - F.col("own"))).alias("gold"))
    near = V.nearest(v, 20, digits=6).select(F.col("vec_id").alias("a"), F.col("nbr_id").alias("b"))
    for end in "ab":
        near = near.join(v.select(F.col("vec_id").alias(end), F.col("label").alias(f"label_{end}")), end)
    found = near.where(F.col("label_a") == F.col("label_b")).groupBy(fold("a")).agg(F.count(F.lit(1)).alias("found"))
    return gold.join(found, "fold", "left").select("fold", "gold", F.coalesce("found", F.lit(0).cast("long")).alias("found"))


@query(
    "gold_quantiles",
    f"WITH {plans._PAIRS} SELECT same, count(*) AS pairs, round(quantile_cont(sim, 0.1), 6) AS p10, round(quantile_cont(sim, 0.5), 6) AS p50, round(quantile_cont(sim, 0.9), 6) AS p90 FROM p GROUP BY same",
)
def gold_quantiles(spark, sf_dir):
    """EV13: score quantiles of gold pairs and of others."""
    q = lambda p: F.round(F.percentile("sim", p, F.col("n")), 6)
    return plans._label_pairs(Tables(spark, sf_dir)).groupBy("same").agg(F.sum("n").alias("pairs"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))


@query(
    "decayed_similarity",
    f"""WITH {plans._SIMS}, k AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims) WHERE n <= 4) SELECT a, b, round(sim * exp(-0.05 * abs(a - b)), 5) AS sim FROM (SELECT x.a, x.b, x.sim FROM k x JOIN k y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)""",
)
def decayed_similarity(spark, sf_dir):
    """EV12: the similarity of mutual neighbours, fading with the days between them."""
    return plans.mutual_knn(spark, sf_dir).select("a", "b", F.round(F.col("sim") * F.exp(-0.05 * F.abs(F.col("a") - F.col("b"))), 5).alias("sim"))


@query("average_linkage")
def average_linkage(spark, sf_dir):
    """EV12: average-linkage clusters of mutual neighbours inside each component; pairs that are none count as 0."""
    pairs = plans.mutual_knn(spark, sf_dir).where(F.col("sim") >= 0.3)
    return S.average_linkage(pairs, 0.12)


@query(
    "duplicate_audit",
    f"""WITH {plans._SIMS}, c AS (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS n FROM sims), e AS (SELECT a, min(b) AS founder FROM c WHERE n <= 5 AND b < a AND sim >= 0.25 GROUP BY a)
    SELECT count(*) AS records, count(founder) AS copies, round(count(founder) / CAST(count(*) AS DOUBLE), 6) AS copy_rate FROM embeddings LEFT JOIN e ON e.a = vec_id""",
)
def duplicate_audit(spark, sf_dir):
    """RP18: records with an earlier near neighbour over the floor count as copies of it."""
    v = Tables(spark, sf_dir).vectors
    near = V.nearest(v, 8).withColumn("sim", F.round("sim", 6))
    five = R.top_per_group(near, ["vec_id"], [F.desc("sim"), F.asc("nbr_id")], 5, "n").where((F.col("nbr_id") < F.col("vec_id")) & (F.col("sim") >= 0.25))
    founder = five.groupBy("vec_id").agg(F.min("nbr_id").alias("founder"))
    n = v.select("vec_id").join(founder, "vec_id", "left").agg(F.count(F.lit(1)).alias("records"), F.count("founder").alias("copies"))
    return n.select("records", "copies", F.round(F.col("copies") / F.col("records"), 6).alias("copy_rate"))


@query("headline_best_match", f"WITH s AS ({ORACLES['title_idf_cosine']}), x AS (SELECT a AS doc_id, b AS match_id, score FROM s UNION ALL SELECT b, a, score FROM s) SELECT doc_id, match_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, match_id) AS n FROM x) WHERE n = 1")
def headline_best_match(spark, sf_dir):
    """TX19 MC5: each headline's best match by IDF cosine, ties to the smaller id."""
    members, pairs = cosine_classes(texts.title_weights(spark, sf_dir), 0.39)
    pairs = pairs.select("a", "b", F.round("score", 5).alias("score"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    # equal headlines have the same matches; the least id of another class is that of its representative
    best = lambda score, id_: F.struct((-score).alias("n"), id_.alias("match_id"))
    others = both.groupBy(F.col("a").alias("rep")).agg(F.min(best(F.col("score"), F.col("b"))).alias("other"))
    second = members.where(F.col("id") != F.col("rep")).groupBy("rep").agg(F.min("id").alias("second"))
    rows = members.join(others, "rep", "left").join(second, "rep", "left")
    own = F.when(F.col("second").isNotNull(), best(F.lit(1.0), F.when(F.col("id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))))
    found = rows.select(F.col("id").alias("doc_id"), F.least("other", own).alias("m")).where(F.col("m").isNotNull())
    return found.select("doc_id", "m.match_id", (-F.col("m.n")).alias("score"))


@query(
    "schema_drift",
    "SELECT event_id, event_type AS entity, CASE event_id % 4 WHEN 0 THEN 'rise' WHEN 1 THEN 'rise' WHEN 2 THEN NULL END AS effect, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS n FROM events",
)
def schema_drift(spark, sf_dir):
    """DM10 DM9: payloads of four shapes read as one: strings as objects, renamed keys, flat as nested, null as empty."""
    e = Tables(spark, sf_dir).clocks
    kind, m = F.col("event_type"), F.col("event_id") % 4
    shape = lambda text: F.format_string(text, kind)
    raw = F.when(m == 0, shape('{"impacts": [{"entity": "%s", "effect": "rise"}]}')).when(m == 1, shape('{"impacts": [{"who": "%s", "what": "rise"}]}')).when(m == 2, shape('{"impacts": ["%s"]}')).otherwise(shape('{"impacts": null, "subject": "%s"}'))
    v = e.select("event_id", F.parse_json(raw).alias("v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    entity = F.coalesce(get("$.impacts[0].entity"), get("$.impacts[0].who"), get("$.subject"), get("$.impacts[0]"))
    count = F.coalesce(F.size(F.try_variant_get("v", "$.impacts", "array<variant>")), F.lit(0))
    return v.select("event_id", entity.alias("entity"), F.coalesce(get("$.impacts[0].effect"), get("$.impacts[0].what")).alias("effect"), F.when(count > 0, 1).otherwise(0).alias("n"))


@query("watermark_merge", "SELECT source, count(*) AS n, CAST(max(doc_id) AS VARCHAR) AS last_id, CASE WHEN source = 'src3' THEN 'kept' ELSE NULL END AS etag FROM documents GROUP BY source")
def watermark_merge(spark, sf_dir):
    """SC6 DM8: new cursor values merged into a source's old ones, key by key."""
    d = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").cast("string").alias("last"))
    old = F.when(F.col("source") == "src3", F.create_map(F.lit("etag"), F.lit("kept"), F.lit("last_id"), F.lit("0"))).otherwise(F.create_map(F.lit("last_id"), F.lit("0")))
    merged = F.map_zip_with(old, F.create_map(F.lit("last_id"), F.col("last")), lambda k, a, b: F.coalesce(b, a))
    return d.withColumn("w", merged).select("source", "n", F.try_element_at("w", F.lit("last_id")).alias("last_id"), F.try_element_at("w", F.lit("etag")).alias("etag"))


@query("file_round_trip", f"WITH {RECORDS} SELECT event_id, sector, status FROM records")
def file_round_trip(spark, sf_dir):
    """SC8 SC9 SC10 SC12: a slice through gzipped JSON lines and CSV."""
    rows = Tables(spark, sf_dir).records.select("event_id", "sector", "status")
    base = f"{scratch_root(spark)}/files-{uuid.uuid4().hex[:12]}"
    files.export_fixture(rows, f"{base}/json")
    back = files.read_jsonl(spark, f"{base}/json", rows.schema)
    files.export_csv(back, f"{base}/csv", ["event_id", "sector", "status"], ["event_id"])
    return files.read_csv(spark, f"{base}/csv", rows.schema)


@query("securities_upsert", "SELECT p_brand AS symbol, arg_max(p_name, (p_size, p_partkey)) AS name, CAST(max(p_size) AS INTEGER) AS listed FROM part GROUP BY p_brand")
def securities_upsert(spark, sf_dir):
    """SC11: listings merged into a master by symbol, the newest winning."""
    a = Tables(spark, sf_dir).actors.select(F.col("brand").alias("symbol"), "name", F.col("size").alias("listed"), "entity_id")
    old, new = a.where(F.col("size") <= 10), a.where(F.col("size") > 10)
    merged = files.upsert(old.withColumn("at", F.struct("listed", "entity_id")), new.withColumn("at", F.struct("listed", "entity_id")), ["symbol"], "at")
    return merged.select("symbol", "name", "listed")


@query("stream_match_or_create", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS founder, count(*) AS members FROM events GROUP BY user_id")
def stream_match_or_create(spark, sf_dir):
    """SS10 MC11: a single writer attaches each row to its record or founds one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = P.files(spark, f"{sf_dir}/events.parquet*", schema, per_trigger=1).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    return P.match_or_create(events, "user_id", "event_id", "at")


@query("sql_functions", ORACLES["url_canonical"])
def sql_functions(spark, sf_dir):
    """UD1 TX1: functions registered for SQL."""
    U.register(spark)
    Tables(spark, sf_dir).raw("pages").createOrReplaceTempView("recordloom_pages")
    return spark.sql("SELECT page_id, canonical_url(url) AS url_canonical FROM recordloom_pages")


@query(
    "sql_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS INTEGER) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""",
)
def sql_sessions(spark, sf_dir):
    """UD1: sessions by a table function over partitioned, ordered rows."""
    tables.register(spark)
    Tables(spark, sf_dir).clocks.select("user_id", "ts").createOrReplaceTempView("recordloom_clocks")
    return spark.sql("SELECT * FROM sessions(TABLE(recordloom_clocks) PARTITION BY user_id ORDER BY (ts), gap_seconds => 7200)")


@query(
    "sql_trimmed_mean",
    """WITH k AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value) AS i, count(value) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS n, CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL)
    SELECT user_id, event_type, day, round(avg(value), 6) AS mean FROM k WHERE i > CAST(floor(n * 0.1) AS BIGINT) AND i <= n - CAST(floor(n * 0.1) AS BIGINT) GROUP BY user_id, event_type, day""",
)
def sql_trimmed_mean(spark, sf_dir):
    """UD1: a mean without its tails by a function in SQL, over what one user did in a day; its groups are too many for one call of Python each."""
    tables.register(spark)
    Tables(spark, sf_dir).clocks.select("user_id", "event_type", F.to_date("ts").alias("day"), "value").createOrReplaceTempView("recordloom_values")
    return spark.sql("SELECT user_id, event_type, day, round(trimmed_mean_of(xs), 6) AS mean FROM (SELECT user_id, event_type, day, collect_list(value) AS xs FROM recordloom_values WHERE value IS NOT NULL GROUP BY user_id, event_type, day)")


@query("sql_chunks", ORACLES["chunked_documents"])
def sql_chunks(spark, sf_dir):
    """UD1 TX9: chunks by a table function in a lateral join."""
    tables.register(spark)
    Tables(spark, sf_dir).documents.select("doc_id", "text").createOrReplaceTempView("recordloom_documents")
    return spark.sql("SELECT doc_id, chunk_index, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM recordloom_documents, LATERAL text_chunks(text)")
