"""Usage, supply and coverage reports on the bound relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.operators import records as R
from recordloom.operators import reports as P
from recordloom.plans.bind import MENTIONS, RECORDS, REPORTS, Tables
from recordloom.plans.registry import query

FIRST, LAST = "2023-12-25", "2024-01-31"


def _last():
    return F.lit("2024-01-30").cast("date")


@query(
    "pipeline_freshness",
    """WITH g AS (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events)
    SELECT event_type, count(gap) AS samples, round(quantile_cont(gap, 0.5), 3) AS p50_s, round(quantile_cont(gap, 0.95), 3) AS p95_s, count(*) FILTER (gap > 86400) AS stalled FROM g GROUP BY event_type""",
)
def pipeline_freshness(spark, sf_dir):
    """AG8 RP11: exact percentiles of the time from one stage to the next, and the backlog."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    g = Tables(spark, sf_dir).clocks.select("event_type", ((micros - F.lag(micros).over(w)) / 1e6).alias("gap"))
    return g.groupBy("event_type").agg(
        F.count("gap").alias("samples"), F.round(F.percentile("gap", 0.5), 3).alias("p50_s"), F.round(F.percentile("gap", 0.95), 3).alias("p95_s"), F.count_if(F.col("gap") > 86400).alias("stalled")
    )


@query(
    "reporting_lag",
    f"""WITH {REPORTS}, f AS (SELECT event_id, source_id, min(published_at) AS told FROM reports GROUP BY ALL), a AS (SELECT event_id, min(told) AS first_at, count(*) AS n FROM f GROUP BY event_id HAVING count(*) >= 2),
    l AS (SELECT source_id, (epoch_us(told) - epoch_us(first_at)) / 3.6e9 AS h, told = first_at AS is_first FROM f JOIN a USING (event_id) WHERE told <= first_at + INTERVAL 700 DAY)
    SELECT source_id AS outlet, count(*) AS stories, count(*) FILTER (is_first) AS firsts, round(quantile_cont(h, 0.5), 3) AS median_hours FROM l GROUP BY source_id HAVING count(*) >= 5""",
)
def reporting_lag(spark, sf_dir):
    """AG9: each outlet's first report against the first of anyone (700 days at this table's pace)."""
    f = Tables(spark, sf_dir).reports.groupBy("event_id", "source_id").agg(F.min("published_at").alias("at"))
    a = f.groupBy("event_id").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    late = f.join(a, "event_id").where(F.col("at") <= F.col("first_at") + F.expr("INTERVAL 700 DAYS")).withColumn("h", R.hours_between(F.col("at"), F.col("first_at")))
    out = late.groupBy(F.col("source_id").alias("outlet")).agg(
        F.count(F.lit(1)).alias("stories"), F.count_if(F.col("at") == F.col("first_at")).alias("firsts"), F.round(F.percentile("h", 0.5), 3).alias("median_hours")
    )
    return out.where(F.col("stories") >= 5)


@query(
    "retention_grid",
    """WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events), f AS (SELECT user_id, min(week) AS cohort FROM w GROUP BY user_id)
    SELECT cohort, CAST((week - cohort) / 7 AS BIGINT) AS k, count(*) AS users FROM w JOIN f USING (user_id) GROUP BY ALL""",
)
def retention_grid(spark, sf_dir):
    """RP6 DM1: weekly cohorts by weeks after."""
    return P.retention(Tables(spark, sf_dir).clocks, "user_id", "ts")


@query(
    "retention_pivot",
    """WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events), f AS (SELECT user_id, min(week) AS cohort FROM w GROUP BY user_id)
    SELECT cohort, count(*) FILTER (week = cohort) AS w0, CASE WHEN cohort + 7 <= DATE '2024-01-22' THEN count(*) FILTER (week = cohort + 7) END AS w1, CASE WHEN cohort + 14 <= DATE '2024-01-22' THEN count(*) FILTER (week = cohort + 14) END AS w2 FROM w JOIN f USING (user_id) GROUP BY cohort""",
)
def retention_pivot(spark, sf_dir):
    """RP6: the grid with null, not zero, for weeks that are not over."""
    grid = P.retention(Tables(spark, sf_dir).clocks, "user_id", "ts").groupBy("cohort").pivot("k", [0, 1, 2]).agg(F.sum("users"))
    over = lambda n: F.when(F.date_add("cohort", 7 * n) <= F.lit("2024-01-22").cast("date"), F.coalesce(F.col(str(n)), F.lit(0)))
    return grid.select("cohort", F.coalesce("0", F.lit(0)).alias("w0"), over(1).alias("w1"), over(2).alias("w2"))


@query(
    "period_vs_previous",
    """SELECT event_type, count(*) FILTER (age < 7) AS current, count(*) FILTER (age >= 7) AS previous FROM (SELECT event_type, DATE '2024-01-30' - CAST(ts AS DATE) AS age FROM events) WHERE age >= 0 AND age < 14 GROUP BY event_type""",
)
def period_vs_previous(spark, sf_dir):
    """RP1: seven days and the seven before."""
    return P.period_vs_previous(Tables(spark, sf_dir).clocks, "event_type", "ts", _last(), 7)


@query(
    "usage_series",
    f"""WITH s AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
    SELECT s.day, CASE WHEN s.day >= DATE '2024-01-01' THEN coalesce(n, 0) END AS n FROM s LEFT JOIN c USING (day)""",
)
def usage_series(spark, sf_dir):
    """RP2 RP13: a day series on a spine, null before counting began."""
    counts = Tables(spark, sf_dir).clocks.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return P.on_spine(P.day_spine(spark, FIRST, LAST), counts, "day", "n", F.lit("2024-01-01").cast("date"))


@query(
    "usage_sections",
    """SELECT 'total' AS section, 'all' AS dim, count(*) AS n FROM events UNION ALL SELECT 'type', event_type, count(*) FROM events GROUP BY event_type UNION ALL SELECT 'weekday', CAST(isodow(ts) AS VARCHAR), count(*) FROM events GROUP BY 2""",
)
def usage_sections(spark, sf_dir):
    """RP3 AG20: sections of measures, one union."""
    e = Tables(spark, sf_dir).clocks
    rows = e.select(F.explode(F.array(
        F.struct(F.lit("total").alias("section"), F.lit("all").alias("dim")), F.struct(F.lit("type").alias("section"), F.col("event_type").alias("dim")),
        F.struct(F.lit("weekday").alias("section"), (F.weekday("ts") + 1).cast("string").alias("dim")),
    )).alias("m"))
    return rows.groupBy("m.section", "m.dim").agg(F.count(F.lit(1)).alias("n"))


@query(
    "running_accounts",
    """WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY user_id), d AS (SELECT day, count(*) AS new_users FROM f GROUP BY day)
    SELECT day, new_users, CAST(sum(new_users) OVER (ORDER BY day) + 1000 AS BIGINT) AS total FROM d""",
)
def running_accounts(spark, sf_dir):
    """WN5 RP4: new accounts per day and their running total on a seed."""
    first = Tables(spark, sf_dir).clocks.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("day"))
    return P.running_total(first.groupBy("day").agg(F.count(F.lit(1)).alias("new_users")), "day", "new_users", 1000)


@query(
    "status_pivot",
    "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
)
def status_pivot(spark, sf_dir):
    """AG17 RP8: day by status with fixed columns."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    p = Tables(spark, sf_dir).clocks.groupBy(F.to_date("ts").alias("day")).pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return p.select("day", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


@query(
    "daily_unique_capped",
    "WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT day, count(*) AS visitors, CAST(sum(least(n, 3)) AS BIGINT) AS counted FROM e GROUP BY day",
)
def daily_unique_capped(spark, sf_dir):
    """SS12: distinct visitors per day, each counted three times at most."""
    return P.capped_daily_unique(Tables(spark, sf_dir).clocks, "user_id", "ts", 3)


@query("question_meter", "SELECT conv_id, count(*) FILTER (role = 'user') AS used, least(count(*) FILTER (role = 'user'), 3) AS allowed, count(*) FILTER (role = 'user') > 3 AS over FROM conversations GROUP BY conv_id")
def question_meter(spark, sf_dir):
    """SS11: questions of each session against a cap."""
    used = F.count_if(F.col("role") == "user")
    return Tables(spark, sf_dir).raw("conversations").groupBy("conv_id").agg(used.alias("used"), F.least(used, F.lit(3)).alias("allowed"), (used > 3).alias("over"))


@query(
    "rolling_day_meter",
    """SELECT event_id, used, used <= 5 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM events)""",
)
def rolling_day_meter(spark, sf_dir):
    """SS11: a meter over the last 24 hours."""
    return P.rolling_meter(Tables(spark, sf_dir).clocks.select("event_id", "user_id", "ts"), "user_id", "ts", 24, 5).select("event_id", "used", "allowed")


@query("minute_meter", "SELECT user_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 1")
def minute_meter(spark, sf_dir):
    """SS11 SS17: a tumbling meter per minute."""
    return Tables(spark, sf_dir).clocks.groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "engagement",
    "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS active, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1",
)
def engagement(spark, sf_dir):
    """RP5: distinct active users and filtered counts per week."""
    e = Tables(spark, sf_dir).clocks
    kind = F.col("event_type")
    return e.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        F.countDistinct("user_id").alias("active"), F.countDistinct(F.when(kind == "purchase", F.col("user_id"))).alias("buyers"), F.count_if(kind == "click").alias("clicks")
    )


@query(
    "funnel_prefix",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END) AS d FROM events GROUP BY ALL)
    SELECT s AS stage, count(*) AS users FROM d, (VALUES ('view', 1), ('click', 2), ('signup', 3), ('purchase', 4)) v(s, n) WHERE d >= n GROUP BY s""",
)
def funnel_prefix(spark, sf_dir):
    """RP7: visits that reached each stage or a later one."""
    e = Tables(spark, sf_dir).clocks.withColumn("visit", F.struct("user_id", F.to_date("ts").alias("day")))
    return P.funnel(e, "visit", "event_type", ["view", "click", "signup", "purchase"])


@query(
    "recurring_revenue",
    "SELECT c_mktsegment AS plan, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT) // CASE WHEN o_orderstatus = 'F' THEN 12 ELSE 1 END) AS BIGINT) AS mrr_cents, count(DISTINCT o_custkey) AS accounts FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def recurring_revenue(spark, sf_dir):
    """RP7: yearly plans count a twelfth each month; money is whole cents."""
    t = Tables(spark, sf_dir)
    rows = t.raw("orders").where(F.col("o_orderstatus") != "P").join(t.raw("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.expr("cast(round(o_totalprice * 100) as bigint) div case when o_orderstatus = 'F' then 12 else 1 end")
    return rows.groupBy(F.col("c_mktsegment").alias("plan")).agg(F.sum(cents).alias("mrr_cents"), F.countDistinct("o_custkey").alias("accounts"))


@query(
    "supply_by_day",
    f"""WITH {RECORDS}, {REPORTS}, c AS (SELECT event_id FROM reports GROUP BY event_id HAVING count(DISTINCT publisher) >= 2)
    SELECT CAST(first_seen AS DATE) AS day, count(*) AS formed, count(c.event_id) AS corroborated FROM records r LEFT JOIN c ON r.event_id = c.event_id GROUP BY 1""",
)
def supply_by_day(spark, sf_dir):
    """RP8: records formed and corroborated per day."""
    t = Tables(spark, sf_dir)
    good = R.corroboration(t.reports).where(F.col("outlets") >= 2).select("event_id", F.lit(1).alias("ok"))
    return t.records.join(good, "event_id", "left").groupBy(F.to_date("first_seen").alias("day")).agg(F.count(F.lit(1)).alias("formed"), F.count("ok").alias("corroborated"))


@query(
    "weekly_export",
    f"""WITH {RECORDS}, {REPORTS}, w AS (SELECT DISTINCT CAST(date_trunc('week', first_seen) AS DATE) AS week FROM records),
    a AS (SELECT CAST(date_trunc('week', first_seen) AS DATE) AS week, count(*) AS records, count(DISTINCT author_id) AS authors FROM records GROUP BY 1), b AS (SELECT CAST(date_trunc('week', published_at) AS DATE) AS week, count(*) AS reports FROM reports GROUP BY 1)
    SELECT week, records, authors, coalesce(reports, 0) AS reports FROM w LEFT JOIN a USING (week) LEFT JOIN b USING (week)""",
)
def weekly_export(spark, sf_dir):
    """RP9 SC12: one row per week, a grouped query per source."""
    t = Tables(spark, sf_dir)
    week = lambda c: F.to_date(F.date_trunc("week", c)).alias("week")
    a = t.records.groupBy(week("first_seen")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("author_id").alias("authors"))
    b = t.reports.groupBy(week("published_at")).agg(F.count(F.lit(1)).alias("reports"))
    return a.join(b, "week", "left").select("week", "records", "authors", F.coalesce("reports", F.lit(0)).alias("reports"))


@query(
    "state_hub",
    f"""WITH {RECORDS}, {REPORTS}, c AS (SELECT event_id, count(DISTINCT publisher) AS n FROM reports GROUP BY event_id)
    SELECT r_name AS region, count(*) AS records, count(*) FILTER (n >= 2) AS multi_outlet, count(*) FILTER (n >= 2) >= 20 AS indexable
    FROM records r JOIN c ON r.event_id = c.event_id JOIN nation ON r.region = n_nationkey JOIN region g ON n_regionkey = g.r_regionkey GROUP BY r_name""",
)
def state_hub(spark, sf_dir):
    """RP12: records per state, those with two outlets, and the floor of 20."""
    t = Tables(spark, sf_dir)
    places = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("region"), F.col("r_name").alias("name"))
    rows = t.records.join(R.corroboration(t.reports).select("event_id", "outlets"), "event_id").join(F.broadcast(places), "region")
    multi = F.count_if(F.col("outlets") >= 2)
    return rows.groupBy(F.col("name").alias("region")).agg(F.count(F.lit(1)).alias("records"), multi.alias("multi_outlet"), (multi >= 20).alias("indexable"))


@query(
    "day_archive",
    f"""WITH s AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS records FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT s.day, first_ts, last_ts, records, max(c.day) OVER (ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_day FROM s LEFT JOIN c ON s.day = c.day""",
)
def day_archive(spark, sf_dir):
    """RP13 AG24: a spine of days with gaps as null and the day before that has records."""
    c = Tables(spark, sf_dir).clocks.where(F.col("event_type") == "error").groupBy(F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("records")
    )
    joined = P.day_spine(spark, FIRST, LAST).join(c, "day", "left")
    held = F.max(F.when(F.col("records").isNotNull(), F.col("day"))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("prev_day", held)


@query(
    "weekly_digest",
    f"""WITH {RECORDS}, {REPORTS}, c AS (SELECT event_id, count(DISTINCT publisher) AS outlets FROM reports GROUP BY event_id)
    SELECT event_id, sector, outlets, CAST(row_number() OVER (ORDER BY outlets DESC, first_seen DESC, event_id) AS INTEGER) AS rnk FROM records JOIN c USING (event_id)
    WHERE first_seen >= TIMESTAMP '2001-07-01' AND first_seen < TIMESTAMP '2001-07-08' QUALIFY rnk <= 10""",
)
def weekly_digest(spark, sf_dir):
    """RP14: the ten records of a week with most outlets."""
    t = Tables(spark, sf_dir)
    week = t.records.where((F.col("first_seen") >= F.lit("2001-07-01").cast("timestamp_ntz")) & (F.col("first_seen") < F.lit("2001-07-08").cast("timestamp_ntz")))
    counts = R.corroboration(t.reports.join(week.select("event_id"), "event_id", "left_semi")).select("event_id", "outlets")
    keys = [F.desc("outlets"), F.desc("first_seen"), F.asc("event_id")]
    top = week.join(counts, "event_id").orderBy(*keys).limit(10)
    return top.withColumn("rnk", F.row_number().over(Window.orderBy(*keys))).select("event_id", "sector", "outlets", "rnk")


@query(
    "market_board",
    f"""WITH {RECORDS}, {REPORTS}, c AS (SELECT event_id, count(DISTINCT publisher) AS outlets FROM reports GROUP BY event_id),
    m AS (SELECT DISTINCT p_brand AS company, l_orderkey AS event_id FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT company, event_id, outlets, row_number() OVER (PARTITION BY company ORDER BY outlets DESC, event_id) AS k, count(*) OVER (PARTITION BY company) AS records FROM m JOIN c USING (event_id))
    SELECT company, event_id, outlets, records FROM x WHERE k = 1""",
)
def market_board(spark, sf_dir):
    """RP15: one row per company, its best record."""
    t = Tables(spark, sf_dir)
    counts = R.corroboration(t.reports).select("event_id", "outlets")
    named = t.mentions.join(t.actors.select("entity_id", F.col("brand").alias("company")), "entity_id").select("company", "event_id").distinct().join(counts, "event_id")
    w = Window.partitionBy("company")
    x = named.withColumn("records", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("outlets"), "event_id")))
    return x.where(F.col("k") == 1).select("company", "event_id", "outlets", "records")


@query("story_outlets", f"WITH {RECORDS}, {REPORTS} SELECT author_id AS story, publisher, count(*) AS reports, count(DISTINCT event_id) AS records FROM reports JOIN records USING (event_id) GROUP BY ALL")
def story_outlets(spark, sf_dir):
    """RP17: reports per outlet of each story."""
    t = Tables(spark, sf_dir)
    return t.reports.join(t.records.select("event_id", F.col("author_id").alias("story")), "event_id").groupBy("story", "publisher").agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("event_id").alias("records"))


@query(
    "backfill_clocks",
    f"""WITH {RECORDS}, {REPORTS}, f AS (SELECT event_id, min(published_at) AS told FROM reports GROUP BY event_id)
    SELECT count(*) AS records, count(*) FILTER (told < first_seen) AS earlier, round(quantile_cont((epoch_us(first_seen) - epoch_us(told)) / 3.6e9, 0.5) FILTER (told < first_seen), 3) AS median_hours FROM f JOIN records USING (event_id)""",
)
def backfill_clocks(spark, sf_dir):
    """RP19: how late records were seen after their first report."""
    t = Tables(spark, sf_dir)
    f = t.reports.groupBy("event_id").agg(F.min("published_at").alias("at")).join(t.records.select("event_id", "first_seen"), "event_id")
    early = F.col("at") < F.col("first_seen")
    return f.agg(F.count(F.lit(1)).alias("records"), F.count_if(early).alias("earlier"), F.round(F.percentile(F.when(early, R.hours_between(F.col("first_seen"), F.col("at"))), 0.5), 3).alias("median_hours"))


@query(
    "median_resolution_days",
    f"WITH {RECORDS}, {REPORTS} SELECT sector, count(*) AS resolved, round(quantile_cont((epoch_us(published_at) - epoch_us(first_seen)) / 8.64e10, 0.5), 3) AS median_days FROM reports JOIN records USING (event_id) WHERE flag = 'R' AND published_at >= first_seen GROUP BY sector",
)
def median_resolution_days(spark, sf_dir):
    """AG10 DM2: the median days from created to resolved."""
    t = Tables(spark, sf_dir)
    rows = t.reports.where(F.col("flag") == "R").join(t.records, "event_id").where(F.col("published_at") >= F.col("first_seen"))
    days = R.hours_between(F.col("published_at"), F.col("first_seen")) / 24
    return rows.groupBy("sector").agg(F.count(F.lit(1)).alias("resolved"), F.round(F.percentile(days, 0.5), 3).alias("median_days"))


@query(
    "goal_split",
    "WITH d AS (SELECT event_type || ':' || CASE WHEN value > 50 THEN 'high' ELSE '' END AS dim, value FROM events) SELECT split_part(dim, ':', 1) AS code, count(*) AS hits, count(*) FILTER (split_part(dim, ':', 2) = 'high') AS goals FROM d GROUP BY 1",
)
def goal_split(spark, sf_dir):
    """AG19 AG18: composite keys split into code and goal."""
    dim = F.concat("event_type", F.lit(":"), F.when(F.col("value") > 50, "high").otherwise(""))
    d = Tables(spark, sf_dir).clocks.select(F.split(dim, ":").alias("p"))
    return d.groupBy(F.col("p")[0].alias("code")).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("p")[1] == "high").alias("goals"))


@query(
    "period_difference",
    """WITH n AS (SELECT user_id, count(*) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1), b AS (SELECT user_id, count(*) AS before FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1)
    SELECT coalesce(n.user_id, b.user_id) AS user_id, coalesce(now, 0) AS now, coalesce(before, 0) AS before FROM n FULL JOIN b ON n.user_id = b.user_id""",
)
def period_difference(spark, sf_dir):
    """ST6: now against before, vanished keys included."""
    e = Tables(spark, sf_dir).clocks.where(F.col("event_type") == "error")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return e.groupBy("user_id").agg(F.count_if(late).alias("now"), F.count_if(~late).alias("before"))


@query("labeller_board", "SELECT source, count(DISTINCT d.doc_id) AS tasks, count(DISTINCT d.doc_id) FILTER (quality = 1) AS good, count(DISTINCT d.doc_id) FILTER (toxic = 1) AS flagged, count(DISTINCT d.doc_id) FILTER (quality IS NULL) AS open FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def labeller_board(spark, sf_dir):
    """AG25: distinct counts with filters over a left join."""
    t = Tables(spark, sf_dir)
    rows = t.raw("documents").select("doc_id", "source").join(t.raw("labels"), "doc_id", "left")
    n = lambda cond: F.countDistinct(F.when(cond, F.col("doc_id")))
    return rows.groupBy("source").agg(F.countDistinct("doc_id").alias("tasks"), n(F.col("quality") == 1).alias("good"), n(F.col("toxic") == 1).alias("flagged"), n(F.col("quality").isNull()).alias("open"))


@query("language_tasks", "SELECT doc_id FROM documents WHERE lang IS NULL OR lang IN ('en', 'de')")
def language_tasks(spark, sf_dir):
    """FP20: a task is open if its languages are a subset of the reader's."""
    d = Tables(spark, sf_dir).documents.withColumn("needs", F.when(F.col("lang").isNotNull(), F.array("lang")))
    return d.where(F.col("needs").isNull() | (F.size(F.array_except("needs", F.array(F.lit("en"), F.lit("de")))) == 0)).select("doc_id")


@query("gate_predicate", "SELECT event_id, value / 100 >= 0.3 AND 1 - value / 100 < 0.4 AS passes FROM events")
def gate_predicate(spark, sf_dir):
    """FP11: two thresholds on one row."""
    p = F.col("value") / 100
    return Tables(spark, sf_dir).clocks.select("event_id", ((p >= 0.3) & (1 - p < 0.4)).alias("passes"))


@query(
    "declared_sector",
    "SELECT doc_id, coalesce(CASE WHEN source IN ('src0', 'src5') THEN 'declared' END, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END) AS sector, source IN ('src0', 'src5') AS bypassed FROM documents",
)
def declared_sector(spark, sf_dir):
    """FP12: a source's declared sector bypasses the model's verdict."""
    d = Tables(spark, sf_dir).raw("documents")
    spec = spark.createDataFrame([("src0", "declared"), ("src5", "declared")], "source string, fixed string")
    model = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return d.join(F.broadcast(spec), "source", "left").select("doc_id", F.coalesce("fixed", model).alias("sector"), F.col("fixed").isNotNull().alias("bypassed"))


@query(
    "watchlist",
    f"""WITH {MENTIONS} SELECT o_orderkey AS event_id FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey IN (SELECT event_id FROM mentions JOIN part ON p_partkey = entity_id WHERE p_brand IN ('Brand#7', 'Brand#9'))""",
)
def watchlist(spark, sf_dir):
    """FP17 FP18: a followed sector or an overlap with followed tickers."""
    t = Tables(spark, sf_dir)
    tickers = t.mentions.join(t.actors.select("entity_id", "brand"), "entity_id").groupBy("event_id").agg(F.collect_set("brand").alias("tickers"))
    follows = F.array(F.lit("Brand#7"), F.lit("Brand#9"))
    rows = t.records.select("event_id", "sector").join(tickers, "event_id", "left")
    return rows.where((F.col("sector") == "1-URGENT") | F.coalesce(F.arrays_overlap("tickers", follows), F.lit(False))).select("event_id")


@query(
    "lens_availability",
    f"WITH {RECORDS} SELECT event_id, concat_ws(',', 'reader', CASE WHEN status = 'F' OR sector = '1-URGENT' THEN 'cyber' END, CASE WHEN weight > 250000 THEN 'markets' END) AS lenses, CASE WHEN weight > 250000 THEN weight END AS paid FROM records",
)
def lens_availability(spark, sf_dir):
    """FP18 FP19 FP14: lenses a record offers, and a paid field blanked without its lens."""
    lenses = F.array_compact(F.array(F.lit("reader"), F.when((F.col("status") == "F") | (F.col("sector") == "1-URGENT"), "cyber"), F.when(F.col("weight") > 250000, "markets")))
    r = Tables(spark, sf_dir).records.withColumn("l", lenses)
    return r.select("event_id", F.array_join("l", ",").alias("lenses"), F.when(F.array_contains("l", "markets"), F.col("weight")).alias("paid"))


@query(
    "local_days",
    "SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, CAST(date_trunc('week', ts + INTERVAL 330 MINUTE) AS DATE) AS monday, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') AS month, CAST(extract(week FROM ts + INTERVAL 330 MINUTE) AS INTEGER) AS iso_week FROM events",
)
def local_days(spark, sf_dir):
    """DM1 SC2: days, weeks and months of Indian time."""
    local = F.col("ts") + F.expr("INTERVAL 330 MINUTES")
    e = Tables(spark, sf_dir).clocks.select("event_id", local.alias("l"))
    return e.select("event_id", F.to_date("l").alias("day"), F.to_date(F.date_trunc("week", "l")).alias("monday"), F.date_format("l", "yyyy-MM").alias("month"), F.weekofyear("l").alias("iso_week"))


@query(
    "occurred_guard",
    f"WITH {RECORDS} SELECT event_id, CASE WHEN CAST(first_seen - INTERVAL (event_id % 5 - 2) DAY AS DATE) <= CAST(first_seen AS DATE) THEN CAST(first_seen - INTERVAL (event_id % 5 - 2) DAY AS DATE) END AS occurred_on FROM records",
)
def occurred_guard(spark, sf_dir):
    """FP15: an ISO date prefix, dropped where it lies after the report's day."""
    r = Tables(spark, sf_dir).records
    told = F.concat(F.date_format(F.date_sub(F.to_date("first_seen"), (F.col("event_id") % 5 - 2).cast("int")), "yyyy-MM-dd"), F.lit("T00:00"))
    day = F.try_to_date(F.substring(told, 1, 10), "yyyy-MM-dd")
    return r.select("event_id", F.when(day <= F.to_date("first_seen"), day).alias("occurred_on"))


@query(
    "headline_choice",
    """WITH t AS (SELECT doc_id % 100 AS record, arg_min(split_part(text, chr(10), 1), doc_id) FILTER (lang = 'fr') AS fr, arg_min(split_part(text, chr(10), 1), doc_id) FILTER (lang = 'en') AS en FROM documents GROUP BY 1) SELECT record, coalesce(fr, en) AS headline FROM t""",
)
def headline_choice(spark, sf_dir):
    """DM11: a headline by language preference with English as fallback."""
    d = Tables(spark, sf_dir).documents.withColumn("record", F.col("doc_id") % 100)
    pick = lambda lang: F.min_by(F.when(F.col("lang") == lang, F.substring_index("text", "\n", 1)), F.when(F.col("lang") == lang, F.col("doc_id")))
    return d.groupBy("record").agg(F.coalesce(pick("fr"), pick("en")).alias("headline"))


@query(
    "coverage_class",
    f"""WITH {REPORTS}, s AS (SELECT event_id, count(DISTINCT n_regionkey) AS regions, count(DISTINCT publisher) AS nations FROM reports JOIN nation ON publisher = n_nationkey GROUP BY event_id)
    SELECT event_id, CASE WHEN regions > 1 THEN 'intl' WHEN nations > 1 THEN 'national' ELSE 'regional' END AS class FROM s""",
)
def coverage_class(spark, sf_dir):
    """DM12: regional, national or international coverage."""
    t = Tables(spark, sf_dir)
    s = t.reports.join(F.broadcast(t.raw("nation").select("n_nationkey", "n_regionkey")), F.col("publisher") == F.col("n_nationkey")).groupBy("event_id").agg(F.countDistinct("n_regionkey").alias("r"), F.countDistinct("publisher").alias("n"))
    return s.select("event_id", F.when(F.col("r") > 1, "intl").when(F.col("n") > 1, "national").otherwise("regional").alias("class"))
