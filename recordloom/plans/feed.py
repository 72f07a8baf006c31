"""Feeds, ranking and record-level counts on the bound relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.operators import records as R
from recordloom.plans.bind import MENTIONS, RECORDS, REPORTS, Tables
from recordloom.plans.registry import query

AS_OF = "2001-08-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    "feed_ranked",
    f"""WITH {RECORDS}, {REPORTS},
    c AS (SELECT event_id, count(DISTINCT publisher) AS source_count FROM reports GROUP BY event_id),
    s AS (SELECT sector, r.event_id, source_count,
            round(greatest(0.0, 1.0 - greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_seen)) / 3.6e9, 0.0) / 168) * 1.0
                  + least(source_count - 1, 4) * 0.25, 6) AS score, first_seen
          FROM records r JOIN c ON r.event_id = c.event_id)
    SELECT sector, event_id, source_count, score, CAST(rnk AS INTEGER) AS rnk
    FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, first_seen DESC, event_id) AS rnk FROM s) WHERE rnk <= 20""",
)
def feed_ranked(spark, sf_dir):
    """AG5 FP1 DM4 JN9 WN12: the ranked feed, 20 records of each sector."""
    t = Tables(spark, sf_dir)
    counts = R.corroboration(t.reports).select("event_id", F.col("outlets").alias("source_count"))
    scored = t.records.join(counts, "event_id").withColumn(
        "score", F.round(R.lens_score(R.hours_between(_as_of(), F.col("first_seen")), F.col("source_count"), 1.0, 0.25), 6)
    )
    return R.top_per_group(scored, ["sector"], [F.desc("score"), F.desc("first_seen"), F.asc("event_id")], 20).select("sector", "event_id", "source_count", "score", "rnk")


@query(
    "corroborated_records",
    f"WITH {REPORTS} SELECT event_id, count(DISTINCT publisher) AS outlets FROM reports GROUP BY event_id HAVING count(DISTINCT publisher) >= 2",
)
def corroborated_records(spark, sf_dir):
    """AG5 AG6: records with two publishers or more."""
    return R.corroboration(Tables(spark, sf_dir).reports).where(F.col("outlets") >= 2).select("event_id", "outlets")


@query(
    "indexable_records",
    f"""WITH {REPORTS}, raw AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1500)
    SELECT event_id, count(DISTINCT publisher) FILTER (s_suppkey IS NULL) AS outlets, count(*) AS reports
    FROM reports LEFT JOIN raw ON source_id = s_suppkey GROUP BY event_id HAVING count(DISTINCT publisher) FILTER (s_suppkey IS NULL) >= 2""",
)
def indexable_records(spark, sf_dir):
    """AG6: publishers among sources that are not raw-record feeds (suppliers of a low balance here)."""
    t = Tables(spark, sf_dir)
    raw = t.raw("supplier").where(F.col("s_acctbal") < 1500).select(F.col("s_suppkey").alias("source_id"), F.lit(1).alias("raw"))
    usual = F.when(F.col("raw").isNull(), F.col("publisher"))
    return t.reports.join(raw, "source_id", "left").groupBy("event_id").agg(F.countDistinct(usual).alias("outlets"), F.count(F.lit(1)).alias("reports")).where(F.col("outlets") >= 2)


@query("served_records", f"WITH {REPORTS} SELECT DISTINCT event_id FROM reports WHERE source_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1500)")
def served_records(spark, sf_dir):
    """FP1: records with at least one report outside the raw-record feeds."""
    t = Tables(spark, sf_dir)
    raw = t.raw("supplier").where(F.col("s_acctbal") < 1500).select(F.col("s_suppkey").alias("source_id"))
    return R.served(t.reports, raw)


@query(
    "scope_filter",
    f"""WITH {RECORDS}, n AS (SELECT event_id, list(DISTINCT r_name ORDER BY r_name) AS regions FROM (
      SELECT l_orderkey AS event_id, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY event_id)
    SELECT event_id, CASE WHEN list_contains(regions, 'ASIA') AND len(regions) = 1 THEN 'regional' WHEN list_contains(regions, 'ASIA') THEN 'national' ELSE 'world' END AS scope,
      array_to_string(regions, ',') AS regions FROM n""",
)
def scope_filter(spark, sf_dir):
    """FP2 DM7: a record's scope from the regions its reports come from."""
    t = Tables(spark, sf_dir)
    nations = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    regions = t.reports.select("event_id", "publisher").distinct().join(nations, F.col("publisher") == F.col("n_nationkey")).groupBy("event_id").agg(F.array_sort(F.collect_set("r_name")).alias("regions"))
    home = F.array_contains("regions", "ASIA")
    scope = F.when(home & (F.size("regions") == 1), "regional").when(home, "national").otherwise("world")
    return regions.select("event_id", scope.alias("scope"), F.array_join("regions", ",").alias("regions"))


@query(
    "interest_narrowing",
    f"""WITH {RECORDS} SELECT event_id, sector, status FROM records
    WHERE sector = '1-URGENT' OR (sector = '2-HIGH' AND status = 'O')""",
)
def interest_narrowing(spark, sf_dir):
    """FP3 TX38: an interest string narrows sectors and optional subsectors."""
    rows = Tables(spark, sf_dir).records
    wanted = spark.createDataFrame([("1-URGENT,2-HIGH:O,unknown:x",)], "q string").select(F.explode(F.split("q", ",")).alias("token"))
    wanted = wanted.select(F.split("token", ":").alias("p")).select(F.col("p")[0].alias("sector"), F.try_element_at("p", F.lit(2)).alias("sub"))
    hit = (rows["sector"] == wanted["sector"]) & (wanted["sub"].isNull() | (rows["status"] == wanted["sub"]))
    return rows.join(F.broadcast(wanted), hit, "left_semi").select("event_id", "sector", "status")


@query("recency_window", f"WITH {RECORDS} SELECT event_id, CAST(first_seen AS DATE) AS day FROM records WHERE first_seen > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND first_seen <= TIMESTAMP '{AS_OF}'")
def recency_window(spark, sf_dir):
    """FP5: strictly after the window's start, up to as_of."""
    seen = F.col("first_seen")
    return Tables(spark, sf_dir).records.where((seen > _as_of() - F.expr("INTERVAL 30 DAYS")) & (seen <= _as_of())).select("event_id", F.to_date("first_seen").alias("day"))


@query(
    "first_published",
    f"""WITH {RECORDS}, {REPORTS} SELECT r.event_id, CAST(coalesce(min(published_at) FILTER (published_at BETWEEN first_seen - INTERVAL 7 DAY AND first_seen + INTERVAL 1 HOUR), min(first_seen)) AS TIMESTAMP) AS first_published
    FROM records r LEFT JOIN reports p ON r.event_id = p.event_id GROUP BY r.event_id""",
)
def first_published(spark, sf_dir):
    """FP6 SS13: the publication clock inside its sanity window."""
    t = Tables(spark, sf_dir)
    return R.first_published(t.reports, t.records)


@query(
    "velocity_trending",
    f"""WITH {REPORTS}, v AS (SELECT event_id, count(DISTINCT publisher) FILTER (published_at > TIMESTAMP '{AS_OF}' - INTERVAL 720 HOUR) AS recent, count(DISTINCT publisher) AS total, max(published_at) AS newest
      FROM reports WHERE published_at <= TIMESTAMP '{AS_OF}' GROUP BY event_id)
    SELECT event_id, recent, total, round((2 * recent + total) * exp(-0.03 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(newest)) / 8.64e10), 6) AS heat
    FROM v ORDER BY heat DESC, event_id LIMIT 30""",
)
def velocity_trending(spark, sf_dir):
    """AG7 WN11 DM3: outlets lately and overall under exponential decay, top 30."""
    v = R.velocity(Tables(spark, sf_dir).reports, _as_of(), 720)
    age = R.hours_between(_as_of(), F.col("newest")) / 24
    heat = F.round((2 * F.col("recent") + F.col("total")) * F.exp(-R.DECAY_PER_DAY * age), 6)
    return v.select("event_id", "recent", "total", heat.alias("heat")).orderBy(F.desc("heat"), "event_id").limit(30)


@query(
    "breaking_records",
    f"""WITH {REPORTS}, f AS (SELECT event_id, min(published_at) AS first_at FROM reports GROUP BY event_id)
    SELECT event_id, count(DISTINCT publisher) AS outlets, count(DISTINCT publisher % 4) AS langs
    FROM reports JOIN f USING (event_id) WHERE published_at <= first_at + INTERVAL 259200 MINUTE GROUP BY event_id
    HAVING count(DISTINCT publisher) >= 6 AND count(DISTINCT publisher % 4) >= 2""",
)
def breaking_records(spark, sf_dir):
    """GR19: six outlets in two languages soon after the first report (180 days at this table's pace)."""
    reports = Tables(spark, sf_dir).reports.withColumn("lang", F.col("publisher") % 4)
    return R.breaking(reports, window_minutes=180 * 24 * 60)


@query(
    "breaking_unless_anticipated",
    f"""WITH {RECORDS}, {REPORTS}, story AS (SELECT event_id, event_id // 4 AS story FROM records),
    b AS (SELECT event_id, count(DISTINCT publisher) AS outlets, min(published_at) AS first_at FROM reports GROUP BY event_id HAVING count(DISTINCT publisher) >= 6),
    before AS (SELECT b.event_id FROM b JOIN story s ON b.event_id = s.event_id JOIN story o ON s.story = o.story AND o.event_id <> s.event_id
      JOIN reports p ON p.event_id = o.event_id AND p.published_at >= b.first_at - INTERVAL 72 DAY AND p.published_at <= b.first_at - INTERVAL 1 DAY
      GROUP BY b.event_id HAVING count(DISTINCT p.publisher) >= 3)
    SELECT event_id, outlets FROM b WHERE event_id NOT IN (SELECT event_id FROM before)""",
)
def breaking_unless_anticipated(spark, sf_dir):
    """GR19 JN14: not breaking if its story already had three outlets before."""
    t = Tables(spark, sf_dir)
    hot = t.reports.groupBy("event_id").agg(F.countDistinct("publisher").alias("outlets"), F.min("published_at").alias("first_at")).where(F.col("outlets") >= 6)
    story = t.records.select("event_id", F.expr("event_id div 4").alias("story"))
    mine = hot.join(story, "event_id")
    others = story.select(F.col("event_id").alias("other"), "story")
    near = (F.col("published_at") >= F.col("first_at") - F.expr("INTERVAL 72 DAYS")) & (F.col("published_at") <= F.col("first_at") - F.expr("INTERVAL 1 DAY"))
    reports = t.reports.select(F.col("event_id").alias("other"), "publisher", "published_at")
    known = (
        mine.join(others, "story").where(F.col("other") != F.col("event_id")).join(reports, "other").where(near)
        .groupBy("event_id").agg(F.countDistinct("publisher").alias("n")).where(F.col("n") >= 3)
    )
    return hot.join(known, "event_id", "left_anti").select("event_id", "outlets")


@query(
    "lead_photo",
    f"""WITH {REPORTS} SELECT event_id, source_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY (flag = 'N') DESC, published_at, source_id, entity_id, position, quantity) AS n FROM reports) WHERE n = 1""",
)
def lead_photo(spark, sf_dir):
    """JN8 WN4: one report per record, the preferred kind first, then the earliest."""
    order = [F.desc(F.col("flag") == "N"), F.asc("published_at"), F.asc("source_id"), F.asc("entity_id"), F.asc("position"), F.asc("quantity")]
    return R.top_per_group(Tables(spark, sf_dir).reports, ["event_id"], order, 1).select("event_id", "source_id", "entity_id")


@query(
    "sector_majority",
    f"""WITH {REPORTS}, c AS (SELECT event_id, flag, count(*) AS n, min(position) AS f FROM reports GROUP BY event_id, flag)
    SELECT event_id, flag, n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f, flag) AS k FROM c) WHERE k = 1""",
)
def sector_majority(spark, sf_dir):
    """AG11: the most frequent value; ties go to the first seen."""
    return R.majority(Tables(spark, sf_dir).reports, "event_id", "flag", "position")


@query(
    "half_membership_vote",
    f"""WITH {REPORTS}, t AS (SELECT event_id, count(*) AS total FROM reports GROUP BY event_id), c AS (SELECT event_id, publisher, count(*) AS n FROM reports GROUP BY event_id, publisher)
    SELECT c.event_id, c.publisher, c.n, t.total FROM c JOIN t ON c.event_id = t.event_id WHERE c.n * 2 >= t.total""",
)
def half_membership_vote(spark, sf_dir):
    """AG12: values that at least half of a record's reports name."""
    return R.half_vote(Tables(spark, sf_dir).reports, "event_id", "publisher").select("event_id", "publisher", "n", "total")


@query(
    "projection_rollup",
    f"""WITH {REPORTS}, {RECORDS} SELECT r.event_id, count(*) AS reports, count(DISTINCT publisher) AS outlets,
      array_to_string(list_sort(list(DISTINCT publisher)), ',') AS publishers, min(CAST(published_at AS DATE)) AS first_day, max(CAST(published_at AS DATE)) AS last_day,
      count(DISTINCT publisher) = 1 AS single_origin, max(quantity) AS top_quantity, arg_max(entity_id, quantity * 1e9 - entity_id) AS top_entity
    FROM reports r JOIN records e ON r.event_id = e.event_id GROUP BY r.event_id""",
)
def projection_rollup(spark, sf_dir):
    """AG13 AG14 JN1: one document per record with counts, sorted sets and a best member."""
    t = Tables(spark, sf_dir)
    return t.reports.join(t.records.select("event_id"), "event_id").groupBy("event_id").agg(
        F.count(F.lit(1)).alias("reports"), F.countDistinct("publisher").alias("outlets"),
        F.array_join(F.array_sort(F.collect_set("publisher")).cast("array<string>"), ",").alias("publishers"),
        F.min(F.to_date("published_at")).alias("first_day"), F.max(F.to_date("published_at")).alias("last_day"),
        (F.countDistinct("publisher") == 1).alias("single_origin"), F.max("quantity").alias("top_quantity"),
        F.max_by("entity_id", F.col("quantity") * 1e9 - F.col("entity_id")).alias("top_entity"),
    )


@query(
    "origin_distribution",
    f"""WITH {REPORTS}, o AS (SELECT event_id, n_name, count(*) AS n FROM reports JOIN nation ON publisher = n_nationkey GROUP BY event_id, n_name)
    SELECT event_id, string_agg(n_name || '=' || CAST(n AS VARCHAR), ',' ORDER BY n_name) AS origins, count(*) = 1 AS single_origin FROM o GROUP BY event_id""",
)
def origin_distribution(spark, sf_dir):
    """AG14 DM8: origins as a map from country to count, printed in key order."""
    t = Tables(spark, sf_dir)
    n = t.reports.join(t.raw("nation"), F.col("publisher") == F.col("n_nationkey")).groupBy("event_id", "n_name").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n")))).alias("origins"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("origins")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("event_id", text.alias("origins"), (F.size("origins") == 1).alias("single_origin"))


@query(
    "founder_ranking",
    f"""WITH {RECORDS} SELECT author_id, event_id, CAST(k AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY (status = 'F') DESC NULLS LAST, first_seen, event_id) AS k FROM records) WHERE k = 1""",
)
def founder_ranking(spark, sf_dir):
    """WN3 WN2: the founder of each group."""
    order = [(F.col("status") == "F").desc_nulls_last(), F.asc("first_seen"), F.asc("event_id")]
    return R.top_per_group(Tables(spark, sf_dir).records, ["author_id"], order, 1).select("author_id", "event_id", "rnk")


@query(
    "round_robin_interleave",
    f"""WITH {REPORTS}, q AS (SELECT event_id, publisher % 4 AS lane, source_id, entity_id, position, quantity, published_at FROM reports),
    p AS (SELECT *, count(*) OVER (PARTITION BY event_id, lane) AS sz, row_number() OVER (PARTITION BY event_id, lane ORDER BY published_at, source_id, entity_id, position, quantity) AS nth FROM q)
    SELECT event_id, lane, source_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY nth, (lane = 0) DESC, sz DESC, lane) AS INTEGER) AS place FROM p""",
)
def round_robin_interleave(spark, sf_dir):
    """WN6: one report per language before any second."""
    rows = Tables(spark, sf_dir).reports.withColumn("lane", F.col("publisher") % 4)
    order = [F.asc(c) for c in ("published_at", "source_id", "entity_id", "position", "quantity")]
    return R.interleave(rows, ["event_id"], "lane", 0, order).select("event_id", "lane", "source_id", "place")


@query(
    "diversity_top_k",
    f"""WITH {REPORTS}, a AS (SELECT event_id, publisher, source_id, quantity, row_number() OVER (PARTITION BY event_id, publisher ORDER BY quantity DESC, source_id, entity_id, position) AS n FROM reports)
    SELECT event_id, publisher, source_id, CAST(k AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY quantity DESC, publisher) AS k FROM a WHERE n = 1) WHERE k <= 4""",
)
def diversity_top_k(spark, sf_dir):
    """WN7: at most four reports per record, one of each publisher."""
    one = R.top_per_group(Tables(spark, sf_dir).reports, ["event_id", "publisher"], [F.desc("quantity"), F.asc("source_id"), F.asc("entity_id"), F.asc("position")], 1, "n")
    return R.top_per_group(one, ["event_id"], [F.desc("quantity"), F.asc("publisher")], 4).select("event_id", "publisher", "source_id", "rnk")


@query(
    "top_band",
    f"""WITH {REPORTS}, b AS (SELECT event_id, source_id, sum(quantity) AS q FROM reports GROUP BY event_id, source_id),
    m AS (SELECT *, max(q) OVER (PARTITION BY event_id) AS best FROM b), k AS (SELECT * FROM m WHERE q >= best - 5)
    SELECT event_id, source_id, q FROM k WHERE event_id NOT IN (SELECT event_id FROM k GROUP BY event_id HAVING count(DISTINCT source_id) > 6)""",
)
def top_band(spark, sf_dir):
    """WN10: candidates within a band of the best, dropped where too many tie."""
    own = Window.partitionBy("event_id")
    sums = Tables(spark, sf_dir).reports.groupBy("event_id", "source_id").agg(F.sum("quantity").alias("q"))
    band = sums.withColumn("best", F.max("q").over(own)).where(F.col("q") >= F.col("best") - 5)
    return band.withColumn("n", F.count(F.lit(1)).over(own)).where(F.col("n") <= 6).select("event_id", "source_id", "q")


@query(
    "clip_runs",
    """WITH r AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events)
    SELECT event_type, min(event_id) AS start_id, max(event_id) AS end_id, count(*) AS n FROM r GROUP BY event_type, g""",
)
def clip_runs(spark, sf_dir):
    """WN9: runs of consecutive ids of one type."""
    return R.islands(Tables(spark, sf_dir).clocks.select("event_type", "event_id"), "event_type", "event_id")


@query(
    "latest_n_per_key",
    """SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20 GROUP BY user_id, event_type""",
)
def latest_n_per_key(spark, sf_dir):
    """WN1: the last 20 rows of each key."""
    last = R.top_per_group(Tables(spark, sf_dir).clocks.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 20)
    return last.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query(
    "trending_order",
    f"""WITH {REPORTS}, {RECORDS}, v AS (SELECT event_id, count(DISTINCT publisher) AS outlets FROM reports GROUP BY event_id)
    SELECT r.event_id, outlets, CAST(row_number() OVER (ORDER BY (r.event_id % 97 = 0) DESC, outlets DESC, first_seen DESC, r.event_id) AS INTEGER) AS rnk
    FROM records r JOIN v ON r.event_id = v.event_id QUALIFY rnk <= 50""",
)
def trending_order(spark, sf_dir):
    """WN13: pinned first, then outlets, recency and id; 50 shown."""
    t = Tables(spark, sf_dir)
    rows = t.records.join(R.corroboration(t.reports).select("event_id", "outlets"), "event_id")
    keys = [F.desc(F.col("event_id") % 97 == 0), F.desc("outlets"), F.desc("first_seen"), F.asc("event_id")]
    shown = rows.orderBy(*keys).limit(50)
    return shown.withColumn("rnk", F.row_number().over(Window.orderBy(*keys))).select("event_id", "outlets", "rnk")


@query("pagination", f"WITH {RECORDS} SELECT event_id, (SELECT count(*) FROM records WHERE sector = '1-URGENT') AS total FROM records WHERE sector = '1-URGENT' ORDER BY first_seen DESC, event_id LIMIT 20 OFFSET 40")
def pagination(spark, sf_dir):
    """WN14: a page with the total."""
    rows = Tables(spark, sf_dir).records.where(F.col("sector") == "1-URGENT")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("first_seen"), "event_id").offset(40).limit(20).select("event_id")
    return page.join(F.broadcast(total))


@query("floor_count", f"WITH {MENTIONS} SELECT entity_id, count(*) >= 5 AS indexable FROM mentions GROUP BY entity_id")
def floor_count(spark, sf_dir):
    """WN15: whether a count reaches its floor."""
    return Tables(spark, sf_dir).mentions.groupBy("entity_id").agg((F.count(F.lit(1)) >= 5).alias("indexable"))


@query(
    "retention_keep_last",
    f"""WITH {RECORDS}, k AS (SELECT author_id, event_id, row_number() OVER (PARTITION BY author_id ORDER BY first_seen DESC, event_id DESC) AS n FROM records)
    SELECT author_id, event_id FROM k WHERE n > 8 AND event_id NOT IN (SELECT event_id FROM records WHERE status = 'P')""",
)
def retention_keep_last(spark, sf_dir):
    """WN16: runs beyond the newest eight that nothing refers to."""
    rows = Tables(spark, sf_dir).records
    old = rows.withColumn("n", F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("first_seen"), F.desc("event_id")))).where(F.col("n") > 8)
    return old.join(rows.where(F.col("status") == "P").select("event_id"), "event_id", "left_anti").select("author_id", "event_id")


@query("seeded_sample", f"WITH {RECORDS} SELECT sector, event_id FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY md5('7:' || CAST(event_id AS VARCHAR))) AS n FROM records) WHERE n <= 10")
def seeded_sample(spark, sf_dir):
    """WN18: an equal pseudorandom sample of each stratum, the same for every run."""
    order = [F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")))]
    return R.top_per_group(Tables(spark, sf_dir).records, ["sector"], order, 10).select("sector", "event_id")


@query(
    "sitemap_feed",
    f"""WITH {RECORDS}, {REPORTS}, v AS (SELECT event_id, max(published_at) AS latest FROM reports GROUP BY event_id HAVING count(DISTINCT publisher) >= 2)
    SELECT r.event_id, CAST(least(latest, TIMESTAMP '{AS_OF}') AS TIMESTAMP) AS lastmod FROM records r JOIN v ON r.event_id = v.event_id ORDER BY lastmod DESC, r.event_id LIMIT 100""",
)
def sitemap_feed(spark, sf_dir):
    """SC13 SC16: the newest indexable records with the lesser of two clocks."""
    t = Tables(spark, sf_dir)
    ok = t.reports.groupBy("event_id").agg(F.max("published_at").alias("latest"), F.countDistinct("publisher").alias("n")).where(F.col("n") >= 2)
    rows = t.records.select("event_id").join(ok, "event_id").select("event_id", F.least("latest", _as_of()).alias("lastmod"))
    return rows.orderBy(F.desc("lastmod"), "event_id").limit(100)
