"""Names that are one entity: spelling variants with evidence, and identifiers from a dictionary of aliases.

Both go by exact keys, never by likeness, and refuse where they can't tell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions import text as T
from recordloom.operators.choice import first_come
from recordloom.operators.components import connected_components
from recordloom.storage import stored

#: Kinds of evidence that two names are one, strongest first.
EVIDENCE = ("record", "link", "story")
#: Kinds of surface forms from strong to weak, and words that an initialism leaves out.
TIERS = ("label", "sitelink", "alias")
JOINERS = ("of", "and", "the", "for", "in", "on", "at", "de", "da", "el", "la")


def grouped(keyed: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity_id, component) of entities that share keys, over any number of steps; ``keyed`` has (entity_id, key)."""
    first = keyed.groupBy("key").agg(F.min(entity).alias("_first"))
    edges = keyed.join(first, "key").select(F.col(entity).alias("u"), F.col("_first").alias("v"))
    return connected_components(edges).select(F.col("node").alias(entity), F.col("root").alias("component"))


def variant_pairs(names: DataFrame) -> DataFrame:
    """(variant, survivor, mentions): names of one kind that share a key, each against its group's most mentioned one.

    ``names`` has (entity_id, kind, slug, mentions); ties go to the smaller id.
    """
    keyed = names.select("entity_id", "mentions", F.explode(T.name_keys(F.col("slug"))).alias("k"), "kind")
    of = grouped(keyed.select("entity_id", F.concat_ws("\x00", "kind", "k").alias("key"))).join(names.select("entity_id", "mentions"), "entity_id")
    best = of.groupBy("component").agg(F.max_by("entity_id", F.struct("mentions", -F.col("entity_id"))).alias("survivor"))
    return of.join(best, "component").where(F.col("entity_id") != F.col("survivor")).select(F.col("entity_id").alias("variant"), "survivor", "mentions")


def _both(pairs: DataFrame, theirs: DataFrame, ours: DataFrame, on: str) -> DataFrame:
    """(variant, survivor) with a value of ``on`` in common: one row per place of a variant, as each has one survivor."""
    at = pairs.join(theirs.withColumnRenamed("entity_id", "variant"), "variant")
    return at.join(ours.withColumnRenamed("entity_id", "survivor"), ["survivor", on], "left_semi").select("variant", "survivor").distinct()


def evidence(pairs: DataFrame, records: DataFrame, links: DataFrame, stories: DataFrame) -> DataFrame:
    """(variant, survivor, evidence): the strongest sign that both name one thing.

    ``records`` has (entity_id, event_id), ``links`` (a, b) of verified records in either
    direction, ``stories`` (event_id, story).
    """
    places = records.select("entity_id", "event_id").distinct()
    either = links.select(F.col("a").alias("event_id"), F.col("b").alias("_other")).unionByName(links.select(F.col("b").alias("event_id"), F.col("a").alias("_other")))
    beyond = places.join(either, "event_id").select("entity_id", F.col("_other").alias("event_id")).distinct()
    told = places.join(stories.select("event_id", "story"), "event_id").select("entity_id", "story").distinct()
    found = [_both(pairs, places, places, "event_id"), _both(pairs, beyond, places, "event_id"), _both(pairs, told, told, "story")]
    all_ = reduce(DataFrame.unionByName, (f.withColumn("_tier", F.lit(n)) for n, f in enumerate(found)))
    names = F.array(*[F.lit(e) for e in EVIDENCE])
    return all_.groupBy("variant", "survivor").agg(F.min("_tier").alias("_tier")).select("variant", "survivor", F.get(names, "_tier").alias("evidence"))


def paired_variants(names: DataFrame, records: DataFrame, links: DataFrame, stories: DataFrame, reports: DataFrame) -> DataFrame:
    """(variant, survivor, evidence, decision): which names become one, under a ban on names that one report uses together.

    ``reports`` has (entity_id, report_id). A report that names two of them tells them apart,
    so they never end up in one group: a variant used beside its survivor is
    ``named_together``, one without evidence ``no_evidence``. The others fold one after
    another, stronger evidence first, then the more mentioned, then the smaller id, and one
    used beside a name that folded before it is ``barred``.
    """
    pairs = stored(variant_pairs(names), "pairs")
    told = evidence(pairs, records, links, stories)
    used = reports.select("entity_id", "report_id").where(F.col("report_id").isNotNull()).distinct()
    beside = _both(pairs, used, used, "report_id").withColumn("_beside", F.lit(True))
    open_ = stored(pairs.join(told, ["variant", "survivor"], "left").join(beside, ["variant", "survivor"], "left"), "open")
    state = F.when(F.col("_beside"), "named_together").when(F.col("evidence").isNull(), "no_evidence")
    tier = F.array_position(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("evidence"))
    asked = open_.where(state.isNull()).withColumn("rank", F.struct(tier.alias("t"), (-F.col("mentions")).alias("m"), F.col("variant").alias("v")))
    claims = asked.join(used.withColumnRenamed("entity_id", "variant"), "variant").withColumn("cell", F.struct("survivor", "report_id"))
    taken = first_come(claims, "variant", "cell", "rank")
    decision = F.coalesce(state, F.when(F.coalesce("taken", F.lit(True)), "fold").otherwise("barred"))
    return open_.join(taken, "variant", "left").select("variant", "survivor", "evidence", decision.alias("decision"))


def alias_key(name: Column) -> Column:
    """The form in which names and surface forms are compared: lower case words with hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N}]+", "-"), "^-|-$", "")


def alias_index(surfaces: DataFrame) -> DataFrame:
    """(key, qid, tier) of (qid, surface, kind): the surface forms that are specific enough to identify an item.

    Labels, titles and aliases of several words are. An alias of one word only is if it is
    made from a label of its item: one of its words, or its initials without joining words.
    """
    kind = F.coalesce("kind", F.lit("alias"))
    rows = surfaces.where(F.col("qid").isNotNull() & (F.col("qid") != "")).select("qid", alias_key(F.col("surface")).alias("key"), kind.alias("kind")).where("key <> ''")
    words = F.split("key", "-")
    spoken = F.filter(words, lambda w: ~w.isin(*JOINERS))
    initials = F.array_join(F.transform(spoken, lambda w: F.substring(w, 1, 1)), "")
    made = rows.where("kind = 'label'").select("qid", F.explode(F.array_append(words, initials)).alias("key")).distinct()
    weak = (F.col("kind") == "alias") & ~F.contains("key", F.lit("-"))
    tier = F.when(F.col("kind") == "label", 0).when(F.col("kind") == "sitelink", 1).otherwise(2)
    kept = rows.where(~weak).unionByName(rows.where(weak).join(made, ["qid", "key"], "left_semi"), allowMissingColumns=True)
    return kept.select("key", "qid", tier.alias("tier")).groupBy("key", "qid").agg(F.min("tier").alias("tier"))


def _one(candidates: DataFrame) -> DataFrame:
    """(key, qid, resolution) of (key, qid, tier): the only candidate, or the only one of the strongest tier there is."""
    tiers = candidates.groupBy("key", "tier").agg(F.min("qid").alias("lo"), F.max("qid").alias("hi"))
    best = tiers.groupBy("key").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.min_by(F.struct("lo", "hi"), "tier").alias("top"), F.min("tier").alias("tier"))
    wins = F.concat(F.get(F.array(*[F.lit(t) for t in TIERS]), "tier"), F.lit("_wins"))
    sure = best.where(F.col("top.lo") == F.col("top.hi"))
    return sure.select("key", F.col("top.lo").alias("qid"), F.when(F.col("first") == F.col("last"), "alias_exact").otherwise(wins).alias("resolution"))


def _narrowed(candidates: DataFrame, ok: Column, tag: str) -> DataFrame:
    """``candidates`` of a key without those that are not ``ok``, if that removes some and leaves some."""
    w = Window.partitionBy("key")  # the items of one surface form, a handful
    n, good = F.count(F.lit(1)).over(w), F.count_if(ok).over(w)
    marked = candidates.withColumn("_cut", (good > 0) & (good < n)).where(~F.col("_cut") | ok)
    return marked.withColumn("applied", F.when(F.col("_cut"), F.concat("applied", F.lit(f"+{tag}"))).otherwise(F.col("applied"))).drop("_cut")


def linked(entities: DataFrame, surfaces: DataFrame, context: DataFrame, home: str) -> DataFrame:
    """(entity_id, qid, resolution, refused): identifiers by exact lookup of (entity_id, name).

    One candidate, or one of the strongest tier, is the answer. Otherwise context
    (qid, defunct, countries) may narrow the candidates, to live ones and only then to those
    of ``home``; if it narrows nothing or still leaves two, the name is refused, and
    ``refused`` lists the candidates it had. Names without a candidate have no row.
    """
    asked = entities.select("entity_id", alias_key(F.col("name")).alias("key"))
    index = stored(alias_index(surfaces).join(asked.select("key").distinct(), "key", "left_semi"), "index")
    sure = _one(index)
    open_ = stored(index.join(sure, "key", "left_anti").withColumn("applied", F.lit("")).join(context.select("qid", "defunct", "countries"), "qid", "left"), "open")
    live = _narrowed(open_, ~F.coalesce("defunct", F.lit(False)), "live")
    near = _narrowed(live, F.coalesce(F.array_contains("countries", home), F.lit(False)), "home")
    rescued = _one(near.where("applied <> ''")).join(near.select("key", "applied").distinct(), "key")
    rescued = stored(rescued.select("key", "qid", F.concat("resolution", "applied").alias("resolution")), "rescued")
    lost = open_.join(rescued, "key", "left_anti").groupBy("key").agg(F.array_sort(F.collect_set("qid")).alias("refused"))
    answers = sure.unionByName(rescued).unionByName(lost, allowMissingColumns=True)
    return asked.join(answers, "key").select("entity_id", "qid", "resolution", "refused")


def fold_groups(entities: DataFrame, links: DataFrame, curated: DataFrame) -> DataFrame:
    """(entity_id, component, qid, refused): entities that are one by identifier, by slug without separators or by a curated alias.

    ``entities`` has (entity_id, slug), ``links`` (entity_id, qid), ``curated`` (slug,
    canonical). A group with two identifiers is refused whole; groups of one have no rows.
    """
    of = entities.select("entity_id", "slug").join(links.where(F.col("qid").isNotNull()).select("entity_id", "qid"), "entity_id", "left").join(curated.select("slug", "canonical"), "slug", "left")
    of = stored(of, "named")
    keys = {"q:": F.col("qid"), "s:": F.replace("slug", F.lit("-"), F.lit("")), "c:": F.coalesce("canonical", "slug")}
    keyed = of.select("entity_id", F.explode(F.array(*[F.concat(F.lit(p), k) for p, k in keys.items()])).alias("key")).where(F.col("key").isNotNull())
    members = grouped(keyed).join(of.select("entity_id", "qid"), "entity_id")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("qid"), (F.min("qid") != F.max("qid")).alias("two"))
    return members.select("entity_id", "component").join(sizes.where("n > 1"), "component").select(
        "entity_id", "component", F.when(~F.coalesce("two", F.lit(False)), F.col("qid")).alias("qid"), F.coalesce("two", F.lit(False)).alias("refused")
    )
