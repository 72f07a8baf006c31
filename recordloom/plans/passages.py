"""Passages of broadcasts placed with records, and clips made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import clips as C
from recordloom.plans.bind import Tables
from recordloom.plans.registry import query

_STOPS = ", ".join(f"'{w}'" for w in C.STOP)
_SPACED = r"' ' || trim(regexp_replace({0}, '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) || ' '"
_PREVIEWS = C.PREVIEW.replace("'", "''")

#: Odd vectors are passages that carry their document's text, even ones records under their document's headline.
_PASSAGES = rf"""d AS (SELECT doc_id, substr(text, 1, 600) AS body, split_part(text, chr(10), 1) AS head, string_split(trim({_SPACED.format('text')}), ' ') AS w FROM documents),
  v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, TIMESTAMP '2024-01-01' + to_hours(vec_id) AS told FROM embeddings),
  ps AS (SELECT vec_id AS passage_id, v, told, body FROM v JOIN d ON doc_id = vec_id WHERE vec_id % 2 = 1),
  rc AS (SELECT vec_id AS event_id, v, told, CASE WHEN vec_id % 3 = 0 THEN 'Minister to launch ' || head ELSE head END AS title, vec_id // 6 AS story FROM v JOIN d ON doc_id = vec_id WHERE vec_id % 2 = 0),
  ct AS (SELECT * FROM (SELECT DISTINCT doc_id AS event_id, unnest([w[3], w[7], w[12]]) AS name FROM d WHERE doc_id % 2 = 0 AND doc_id IN (SELECT vec_id FROM v)) WHERE name IS NOT NULL),
  lk AS (SELECT passage_id, passage_id - 1 AS event_id FROM ps WHERE passage_id % 9 = 0 AND passage_id - 1 IN (SELECT event_id FROM rc)),
  k8 AS (SELECT passage_id, event_id, sim FROM (SELECT passage_id, event_id, sim, row_number() OVER (PARTITION BY passage_id ORDER BY round(1 - sim, 6), event_id) AS nth FROM (
    SELECT passage_id, event_id, round(list_cosine_similarity(p.v, r.v), 6) AS sim FROM ps p JOIN rc r ON r.told BETWEEN p.told - INTERVAL 72 HOUR AND p.told + INTERVAL 72 HOUR) WHERE round(1 - sim, 6) <= 0.8) WHERE nth <= 8),
  nr AS (SELECT k8.*, title, story, body FROM k8 JOIN rc USING (event_id) JOIN ps USING (passage_id) WHERE (passage_id, event_id) NOT IN (SELECT (passage_id, event_id) FROM lk) AND NOT (regexp_matches(title, '{_PREVIEWS}') AND ps.told - rc.told > INTERVAL 24 HOUR)),
  bd AS (SELECT * FROM (SELECT *, max(sim) OVER (PARTITION BY passage_id) AS best FROM nr) WHERE sim >= best - 0.03 - 1e-9), mg AS (SELECT passage_id FROM bd GROUP BY passage_id HAVING count(DISTINCT story) <= 2),
  rare AS (SELECT * FROM ct WHERE name NOT IN (SELECT name FROM ct GROUP BY name HAVING count(*) > 0.01 * (SELECT count(*) FROM rc))),
  ok AS (SELECT passage_id, event_id, story, sim FROM bd WHERE passage_id IN (SELECT passage_id FROM mg) AND (passage_id * 7 + event_id) % 5 <> 0 AND (
    EXISTS (SELECT 1 FROM rare WHERE rare.event_id = bd.event_id AND length(trim(name)) >= 3 AND CASE WHEN length(trim(name)) = 3 THEN contains({_SPACED.format('body')}, {_SPACED.format('name')}) ELSE contains({_SPACED.format('lower(body)')}, {_SPACED.format('lower(name)')}) END)
    OR len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z][a-z0-9'']{{3,}}')), lambda x: x NOT IN ({_STOPS})), string_split(trim({_SPACED.format('lower(body)')}), ' '))) >= 2)),
  every AS (SELECT passage_id, event_id, story, sim AS score, 'judge' AS method FROM ok UNION ALL SELECT passage_id, event_id, event_id // 6, 1.0, 'url' FROM lk),
  pl AS (SELECT passage_id, event_id, story, CAST(score AS DOUBLE) AS score, method FROM (SELECT *, row_number() OVER (PARTITION BY passage_id, story ORDER BY score DESC, event_id) AS nth FROM every) WHERE nth = 1)"""


def _placed(t: Tables):
    d = t.documents
    words = F.split(F.trim(C._spaced(F.col("text"))), " ")
    docs = d.select("doc_id", F.substring("text", 1, 600).alias("body"), F.substring_index("text", "\n", 1).alias("head"), F.array(*[F.get(words, i) for i in (2, 6, 11)]).alias("w"))
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(vec_id AS INT), 0, 0)")
    v = t.vectors.select("vec_id", F.col("embedding").alias("vector"), at.alias("at")).join(docs, F.col("vec_id") == F.col("doc_id"))
    i = F.col("vec_id")
    address = lambda n: F.concat(F.lit("https://reports.example/"), n.cast("string"))
    urls = F.when(i % 9 == 0, F.array(address(i - 1), F.lit("https://elsewhere.example/"))).otherwise(F.array().cast("array<string>"))
    passages = v.where(i % 2 == 1).select(i.alias("passage_id"), "at", F.col("body").alias("text"), "vector", urls.alias("urls"))
    title = F.when(i % 3 == 0, F.concat(F.lit("Minister to launch "), "head")).otherwise(F.col("head"))
    even = v.where(i % 2 == 0)
    records = even.select(i.alias("event_id"), title.alias("title"), "at", "vector")
    cast = even.select(i.alias("event_id"), F.explode("w").alias("name")).where(F.col("name").isNotNull()).distinct()
    stories = even.select(i.alias("event_id"), F.expr("vec_id div 6").alias("story"))
    judge = lambda asked: asked.withColumn("ok", (F.col("passage_id") * 7 + F.col("event_id")) % 5 != 0)
    # a lower floor and fewer stories than by default: these vectors are not sentences
    return C.placed(passages, records, even.select(i.alias("event_id"), address(i).alias("url")), cast, stories, judge, min_cos=0.2, magnet=2)


@query("passage_placement", f"WITH {_PASSAGES} SELECT passage_id, event_id, story, score, method FROM pl")
def passage_placement(spark, sf_dir):
    """MC21: passages placed by address, or by the nearest records of 72 hours that a rare name or two title words confirm."""
    return _placed(Tables(spark, sf_dir))


@query(
    "grown_clips",
    """WITH RECURSIVE h AS (SELECT DISTINCT o_custkey AS event_id, l_partkey // 50 AS episode, l_partkey % 50 AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    s AS (SELECT *, seq * 20.0 AS start_s, seq * 20.0 + 15 + (seq * 7 + event_id) % 12 AS end_s, ((event_id * 31 + episode * 7 + seq * 13) % 97) / 100.0 AS score, seq - row_number() OVER (PARTITION BY event_id, episode ORDER BY seq) AS run FROM h),
    r AS (SELECT event_id, episode, run, list({'seq': seq, 'start_s': start_s, 'end_s': end_s, 'score': score} ORDER BY seq) AS p FROM s GROUP BY ALL),
    b AS (SELECT *, list_position(list_transform(p, lambda x: x.score), list_max(list_transform(p, lambda x: x.score))) AS best FROM r),
    g AS (SELECT event_id, episode, run, p, best, best AS lo, best AS hi, 0 AS k FROM b
      UNION ALL SELECT event_id, episode, run, p, best, lo2, CASE WHEN hi < len(p) AND p[hi + 1].end_s - p[lo2].start_s <= 90 THEN hi + 1 ELSE hi END, k + 1
      FROM (SELECT *, CASE WHEN lo > 1 AND p[hi].end_s - p[lo - 1].start_s <= 90 THEN lo - 1 ELSE lo END AS lo2 FROM g WHERE k < len(p))),
    f AS (SELECT event_id, episode, p[best].seq AS seq, p[lo].start_s AS start_s, p[hi].end_s AS end_s, p[best].score AS score FROM g WHERE k = len(p)),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, episode ORDER BY score DESC, seq) AS n FROM f) WHERE n = 1)
    SELECT event_id, episode, seq, CAST(start_s AS DOUBLE) AS start_s, CAST(end_s AS DOUBLE) AS end_s, CAST(score AS DOUBLE) AS score, CAST(rnk AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, episode, seq) AS rnk FROM o) WHERE rnk <= 4""",
)
def grown_clips(spark, sf_dir):
    """WN9 WN7: passages in a row become one clip, grown from the best within ninety seconds; four of each record, one of each episode."""
    t = Tables(spark, sf_dir)
    hits = t.dossiers.select("event_id", F.expr("entity_id div 50").alias("episode"), (F.col("entity_id") % 50).alias("seq"))
    start = F.col("seq") * 20.0
    score = (F.col("event_id") * 31 + F.col("episode") * 7 + F.col("seq") * 13) % 97 / 100.0
    hits = hits.select("event_id", "episode", "seq", start.alias("start_s"), (start + 15 + (F.col("seq") * 7 + F.col("event_id")) % 12).alias("end_s"), score.alias("score"))
    return C.clips(hits).select("event_id", "episode", "seq", "start_s", "end_s", "score", "rnk")
