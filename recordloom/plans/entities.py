"""Entities under several names: variants paired by evidence, identifiers from a dictionary of aliases.

The names are spelled from the part keys, a dozen to a name; reports, records and stories
are the lines of one flag in an order, orders and customers.
"""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators import entities as E
from recordloom.plans.bind import Tables
from recordloom.plans.registry import query
from recordloom.storage import stored

_FOLDED = "replace(slug, '-', ' ')"
for _a, _b in T.FOLDS:
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
for _a in string.ascii_lowercase:
    _FOLDED = f"regexp_replace({_FOLDED}, '{_a}{_a}+', '{_a}', 'g')"
_VARIANTS = f"""spelled AS (SELECT p_partkey AS entity_id, p_partkey // 12 AS g, p_partkey % 12 AS r, translate(CAST(p_partkey // 12 AS VARCHAR), '0123456789', 'bdgklmnprt') AS code,
    CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'e' WHEN 2 THEN 'i' ELSE 'o' END AS v FROM part),
  n AS (SELECT entity_id, CASE WHEN r = 11 THEN 'organisation' ELSE 'person' END AS kind,
    CASE WHEN entity_id % 3 = 1 THEN 'narendrra' ELSE 'narendra' END || CASE WHEN r IN (5, 8) THEN '' ELSE '-' END || regexp_replace(code, '(.)', '\\1' || v, 'g') AS slug, count(*) AS mentions
    FROM spelled JOIN lineitem ON l_partkey = entity_id GROUP BY ALL),
  sk AS (SELECT entity_id, kind, trim(regexp_replace(regexp_replace({_FOLDED}, '[aeiouy]', '', 'g'), ' +', ' ', 'g')) AS sk FROM n),
  k AS (SELECT entity_id, kind, 'r:' || replace(slug, '-', '') AS key FROM n UNION SELECT entity_id, kind, 's:' || sk FROM sk WHERE contains(sk, ' ') AND length(replace(sk, ' ', '')) >= 5),
  adj AS (SELECT DISTINCT a.entity_id AS x, b.entity_id AS y FROM k a JOIN k b USING (kind, key)),
  reach AS (SELECT x AS node, y AS r FROM adj UNION SELECT reach.node, adj.y FROM reach JOIN adj ON reach.r = adj.x),
  comp AS (SELECT node AS entity_id, min(r) AS component FROM reach GROUP BY node),
  best AS (SELECT component, arg_max(entity_id, (mentions, -entity_id)) AS survivor FROM comp JOIN n USING (entity_id) GROUP BY component),
  pr AS (SELECT entity_id AS variant, survivor, mentions FROM comp JOIN best USING (component) JOIN n USING (entity_id) WHERE entity_id <> survivor),
  rec AS (SELECT DISTINCT l_partkey AS e, l_orderkey AS o FROM lineitem), lk AS (SELECT a.o_orderkey AS o, b.o_orderkey AS p FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderkey % 4 = 0),
  lks AS (SELECT o, p FROM lk UNION SELECT p, o FROM lk), st AS (SELECT DISTINCT e, o_custkey AS s FROM rec JOIN orders ON o_orderkey = o),
  ev AS (SELECT variant, min(tier) AS tier FROM (
      SELECT variant, 0 AS tier FROM pr JOIN rec a ON a.e = variant JOIN rec b ON b.e = survivor AND b.o = a.o
      UNION ALL SELECT variant, 1 FROM pr JOIN rec a ON a.e = variant JOIN lks ON lks.o = a.o JOIN rec b ON b.e = survivor AND b.o = lks.p
      UNION ALL SELECT variant, 2 FROM pr JOIN st a ON a.e = variant JOIN st b ON b.e = survivor AND b.s = a.s) GROUP BY variant),
  rep AS (SELECT DISTINCT l_partkey AS e, l_orderkey || l_returnflag AS o FROM lineitem), tog AS (SELECT DISTINCT variant FROM pr JOIN rep a ON a.e = variant JOIN rep b ON b.e = survivor AND b.o = a.o),
  v AS (SELECT variant, survivor, row_number() OVER (PARTITION BY survivor ORDER BY tier, mentions DESC, variant) AS place, (SELECT list(o) FROM rep WHERE e = variant) AS used FROM pr JOIN ev USING (variant) WHERE variant NOT IN (SELECT variant FROM tog)),
  chosen AS (SELECT survivor, CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS variant, true AS ok FROM (SELECT DISTINCT survivor FROM v)
    UNION ALL SELECT c.survivor, v.place, CASE WHEN list_has_any(v.used, c.taken) THEN c.taken ELSE list_concat(c.taken, v.used) END, v.variant, NOT list_has_any(v.used, c.taken) FROM chosen c JOIN v ON v.survivor = c.survivor AND v.place = c.place + 1)"""


def _variants(t: Tables):
    p = F.col("p_partkey")
    vowel = F.when(p % 4 == 0, "a").when(p % 4 == 1, "e").when(p % 4 == 2, "i").otherwise("o")
    code = F.translate(F.expr("p_partkey div 12").cast("string"), "0123456789", "bdgklmnprt")
    slug = F.concat(F.when(p % 3 == 1, "narendrra").otherwise("narendra"), F.when((p % 12).isin(5, 8), "").otherwise("-"), F.regexp_replace(code, F.lit("(.)"), F.concat(F.lit("$1"), vowel)))
    spelled = t.raw("part").select(p.alias("entity_id"), F.when(p % 12 == 11, "organisation").otherwise("person").alias("kind"), slug.alias("slug"))
    counts = t.raw("lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("mentions"))
    return spelled.join(counts, "entity_id")


@query(
    "variant_pairing",
    f"""WITH RECURSIVE {_VARIANTS}
    SELECT pr.variant, pr.survivor, CASE tier WHEN 0 THEN 'record' WHEN 1 THEN 'link' WHEN 2 THEN 'story' END AS evidence,
      CASE WHEN pr.variant IN (SELECT variant FROM tog) THEN 'named_together' WHEN tier IS NULL THEN 'no_evidence' WHEN ok THEN 'fold' ELSE 'barred' END AS decision
    FROM pr LEFT JOIN ev USING (variant) LEFT JOIN chosen ON chosen.variant = pr.variant""",
)
def variant_pairing(spark, sf_dir):
    """MC19: spellings of one name fold into the most mentioned on evidence, and never two that one report uses together."""
    t = Tables(spark, sf_dir)
    lines, orders = t.raw("lineitem"), t.raw("orders")
    entity = F.col("l_partkey").alias("entity_id")
    next_ = orders.select(F.col("o_orderkey").alias("b"))
    links = orders.where(F.col("o_orderkey") % 4 == 0).select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b")).join(next_, "b", "left_semi")
    stories = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("story"))
    reports = lines.select(entity, F.concat(F.col("l_orderkey").cast("string"), "l_returnflag").alias("report_id"))
    return E.paired_variants(stored(_variants(t), "names"), lines.select(entity, F.col("l_orderkey").alias("event_id")), links, stories, reports)


_DICTIONARY = """spelled AS (SELECT p_partkey AS entity_id, p_partkey // 12 AS g, p_partkey % 12 AS r, translate(CAST(p_partkey // 12 AS VARCHAR), '0123456789', 'bdgklmnprt') AS code FROM part),
  forms AS (SELECT *, 'narendra' || regexp_replace(code, '(.)', ' \\1a', 'g') AS fa, 'narendra' || regexp_replace(code, '(.)', ' \\1e', 'g') AS fe, 'narendra' || regexp_replace(code, '(.)', ' \\1i', 'g') AS fi, 'narendra' || regexp_replace(code, '(.)', ' \\1o', 'g') AS fo FROM spelled),
  ents AS (SELECT entity_id, CASE WHEN r IN (0, 4, 8) THEN fa WHEN r IN (1, 5) THEN fe WHEN r IN (2, 6) THEN fi WHEN r IN (3, 7) THEN fo WHEN r = 9 THEN 'zz' || code WHEN r = 10 THEN 'n' || code ELSE replace(fa, ' ', '') END AS name FROM forms),
  gs AS (SELECT DISTINCT g, code, fa, fe, fi, fo FROM forms),
  surfaces AS (SELECT 'Q' || g AS qid, fa AS surface, 0 AS tier FROM gs UNION ALL SELECT 'D' || g, fa, 0 FROM gs WHERE g % 5 = 0 UNION ALL SELECT 'Q' || g, fi, 1 FROM gs UNION ALL SELECT 'Q' || (g + 1), fi, 2 FROM gs
    UNION ALL SELECT 'Q' || g, fe, 2 FROM gs UNION ALL SELECT 'Q' || g, 'n' || code, 2 FROM gs UNION ALL SELECT 'Q' || g, 'zz' || code, 2 FROM gs UNION ALL SELECT 'Q' || g, replace(fa, ' ', ''), 2 FROM gs),
  keyed AS (SELECT qid, replace(surface, ' ', '-') AS key, tier FROM surfaces),
  idx AS (SELECT key, qid, min(tier) AS tier FROM keyed k WHERE tier < 2 OR contains(key, '-') OR key IN (SELECT unnest(list_append(string_split(l.key, '-'), list_aggregate(list_transform(list_filter(string_split(l.key, '-'), lambda w: w NOT IN ('of', 'and', 'the', 'for', 'in', 'on', 'at', 'de', 'da', 'el', 'la')), lambda w: w[1]), 'string_agg', ''))) FROM keyed l WHERE l.tier = 0 AND l.qid = k.qid) GROUP BY key, qid),
  ctx AS (SELECT 'Q' || g AS qid, g % 30 = 0 AS dead, true AS home FROM gs UNION ALL SELECT 'D' || g, g % 10 = 0, g % 15 = 0 FROM gs WHERE g % 5 = 0),
  asked AS (SELECT DISTINCT replace(name, ' ', '-') AS key FROM ents),
  tops AS (SELECT key, count(DISTINCT qid) AS n, min(tier) AS top FROM idx WHERE key IN (SELECT key FROM asked) GROUP BY key),
  strong AS (SELECT key, any_value(n) AS n, any_value(top) AS top, count(DISTINCT qid) AS m, min(qid) AS qid FROM idx JOIN tops USING (key) WHERE tier = top GROUP BY key),
  sure AS (SELECT key, qid, CASE WHEN n = 1 THEN 'alias_exact' ELSE ['label', 'sitelink', 'alias'][top + 1] || '_wins' END AS resolution FROM strong WHERE m = 1),
  open AS (SELECT idx.*, coalesce(dead, false) AS dead, coalesce(home, false) AS home FROM idx LEFT JOIN ctx USING (qid) WHERE key IN (SELECT key FROM strong WHERE m > 1)),
  live AS (SELECT * FROM (SELECT *, count(*) FILTER (NOT dead) OVER (PARTITION BY key) AS good, count(*) OVER (PARTITION BY key) AS n FROM open) WHERE NOT (good > 0 AND good < n) OR NOT dead),
  near AS (SELECT * FROM (SELECT key, qid, tier, home, CASE WHEN good > 0 AND good < n THEN '+live' ELSE '' END AS a1, count(*) FILTER (home) OVER (PARTITION BY key) AS good2, count(*) OVER (PARTITION BY key) AS n2 FROM live) WHERE NOT (good2 > 0 AND good2 < n2) OR home),
  nt AS (SELECT key, any_value(a1 || CASE WHEN good2 > 0 AND good2 < n2 THEN '+home' ELSE '' END) AS applied, count(DISTINCT qid) AS n, min(tier) AS top FROM near GROUP BY key),
  ns AS (SELECT key, any_value(nt.n) AS n, any_value(applied) AS applied, any_value(top) AS top, count(DISTINCT qid) AS m, min(qid) AS qid FROM near JOIN nt USING (key) WHERE tier = top GROUP BY key),
  rescued AS (SELECT key, qid, CASE WHEN n = 1 THEN 'alias_exact' ELSE ['label', 'sitelink', 'alias'][top + 1] || '_wins' END || applied AS resolution FROM ns WHERE m = 1 AND applied <> ''),
  got AS (SELECT * FROM sure UNION ALL SELECT * FROM rescued),
  links AS (SELECT entity_id, qid, resolution FROM ents JOIN got ON key = replace(name, ' ', '-'))"""


def _dictionary(t: Tables):
    """(entities, surfaces, context, curated): two of the four spellings of a name and its initials are in the dictionary; some items have a namesake."""
    p = F.col("p_partkey")
    code = F.translate(F.expr("p_partkey div 12").cast("string"), "0123456789", "bdgklmnprt")
    form = lambda v: F.concat(F.lit("narendra"), F.regexp_replace("code", "(.)", f" $1{v}"))
    spelled = t.raw("part").select(p.alias("entity_id"), F.expr("p_partkey div 12").alias("g"), (p % 12).alias("r"), code.alias("code"))
    forms = stored(spelled.select("*", *[form(v).alias(f"f{v}") for v in "aeio"]), "forms")
    r = F.col("r")
    joined = F.replace("fa", F.lit(" "), F.lit(""))
    initials, alone = F.concat(F.lit("n"), "code"), F.concat(F.lit("zz"), "code")
    name = F.when(r.isin(0, 4, 8), F.col("fa")).when(r.isin(1, 5), F.col("fe")).when(r.isin(2, 6), F.col("fi")).when(r.isin(3, 7), F.col("fo")).when(r == 9, alone).when(r == 10, initials).otherwise(joined)
    entities = forms.select("entity_id", name.alias("name"), F.replace(name, F.lit(" "), F.lit("-")).alias("slug"))
    g = F.col("g")
    items = forms.select("g", "code", "fa", "fe", "fi", "fo").distinct()
    q = lambda n: F.concat(F.lit("Q"), n.cast("string"))
    twin = F.concat(F.lit("D"), g.cast("string"))
    row = lambda qid, surface, kind: F.struct(qid.alias("qid"), surface.alias("surface"), F.lit(kind).alias("kind"))
    rows = [row(q(g), F.col("fa"), "label"), row(q(g), F.col("fi"), "sitelink"), row(q(g + 1), F.col("fi"), "alias")]
    rows += [row(q(g), c, "alias") for c in (F.col("fe"), initials, alone, joined)]
    namesakes = items.where(g % 5 == 0)
    surfaces = items.select(F.inline(F.array(*rows))).unionByName(namesakes.select(row(twin, F.col("fa"), "label").alias("x")).select("x.*"))
    home, away = F.array(F.lit("in")), F.array(F.lit("uk"))
    context = items.select(q(g).alias("qid"), (g % 30 == 0).alias("defunct"), home.alias("countries")).unionByName(
        namesakes.select(twin.alias("qid"), (g % 10 == 0).alias("defunct"), F.when(g % 15 == 0, home).otherwise(away).alias("countries"))
    )
    slug = lambda c: F.replace(c, F.lit(" "), F.lit("-"))
    beyond = F.concat(F.lit("narendra"), F.regexp_replace(F.translate((g + 1).cast("string"), "0123456789", "bdgklmnprt"), "(.)", " $1a"))
    curated = items.where(g % 2 == 0).select(slug(F.col("fo")).alias("slug"), slug(F.col("fa")).alias("canonical")).unionByName(
        items.where(g % 8 == 1).select(slug(F.col("fi")).alias("slug"), slug(beyond).alias("canonical"))
    )
    return entities, surfaces, context, curated


def _linked(t: Tables):
    entities, surfaces, context, curated = _dictionary(t)
    return entities, E.linked(entities, surfaces, context, "in"), curated


@query("identifier_links", f"WITH {_DICTIONARY} SELECT entity_id, qid, resolution FROM links")
def identifier_links(spark, sf_dir):
    """MC20: names linked to an item by an exact, identifying alias, by its strongest kind, or once context leaves one."""
    return _linked(Tables(spark, sf_dir))[1].where(F.col("qid").isNotNull()).select("entity_id", "qid", "resolution")


@query(
    "identifier_refusals",
    f"WITH {_DICTIONARY} SELECT entity_id, list_aggregate(list_sort(list(DISTINCT qid)), 'string_agg', ',') AS candidates FROM ents JOIN open ON key = replace(name, ' ', '-') WHERE key NOT IN (SELECT key FROM rescued) GROUP BY entity_id",
)
def identifier_refusals(spark, sf_dir):
    """MC20: names that still have two items after narrowing are refused, with the items they had."""
    found = _linked(Tables(spark, sf_dir))[1]
    return found.where(F.col("refused").isNotNull()).select("entity_id", F.array_join("refused", ",").alias("candidates"))


@query(
    "identifier_groups",
    f"""WITH RECURSIVE {_DICTIONARY}, slugs AS (SELECT entity_id, replace(name, ' ', '-') AS slug FROM ents),
    curated AS (SELECT replace(fo, ' ', '-') AS slug, replace(fa, ' ', '-') AS canonical FROM gs WHERE g % 2 = 0
      UNION ALL SELECT replace(a.fi, ' ', '-'), replace('narendra' || regexp_replace(translate(CAST(a.g + 1 AS VARCHAR), '0123456789', 'bdgklmnprt'), '(.)', ' \\1a', 'g'), ' ', '-') FROM gs a WHERE a.g % 8 = 1),
    ks AS (SELECT entity_id, 'q:' || qid AS key FROM links UNION SELECT entity_id, 's:' || replace(slug, '-', '') FROM slugs UNION SELECT entity_id, 'c:' || coalesce(canonical, slug) FROM slugs LEFT JOIN curated USING (slug)),
    adj AS (SELECT DISTINCT a.entity_id AS x, b.entity_id AS y FROM ks a JOIN ks b USING (key)), reach AS (SELECT x AS node, y AS r FROM adj UNION SELECT reach.node, adj.y FROM reach JOIN adj ON reach.r = adj.x),
    comp AS (SELECT node AS entity_id, min(r) AS component FROM reach GROUP BY node), s AS (SELECT component, count(*) AS n, count(DISTINCT qid) AS q, min(qid) AS qid FROM comp LEFT JOIN links USING (entity_id) GROUP BY component)
    SELECT entity_id, component, CASE WHEN q = 1 THEN qid END AS qid, q > 1 AS refused FROM comp JOIN s USING (component) WHERE n > 1""",
)
def identifier_groups(spark, sf_dir):
    """MC20: names that are one by identifier, by slug without separators or by a curated alias; two identifiers refuse the group."""
    entities, found, curated = _linked(Tables(spark, sf_dir))
    return E.fold_groups(entities, found, curated)
