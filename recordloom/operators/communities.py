"""Communities that hold much the same members, found by containment and thinned by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.choice import first_come
from recordloom.operators.sparse import SMALL, decide, jaccard_pairs
from recordloom.operators.stories import _tasks
from recordloom.storage import stored

#: The share of the smaller community that makes two one, and the least support.
OVERLAP = 0.6
LEAST_OUTLETS = 2
LEAST_MEMBERS = 2


#: Members of more sets than this make no pairs by themselves; what two sets share of them comes from the sets' own lists.
HUB = 64


def contained_pairs(sets: DataFrame, share: float = OVERLAP) -> DataFrame:
    """(a, b, overlap): pairs of (set_id, member), or whole (set_id, members), sets that share at least ``share`` of the smaller one's members.

    Exact. A member's list of sets, smaller ones first, travels to each of them, and is
    spread there into the larger sets and counted. Members of very many sets are left out;
    what two sets share of those is added from their own lists. Two sets that share nothing
    else meet on the rarest few they have to share (``sparse.decide``).
    """
    return _contained(_grouped(sets), share)


def _grouped(sets: DataFrame) -> DataFrame:
    """(id, s): each set's members, stored; sets that come whole, as (set_id, members) without repeats, are taken as they are."""
    some = sets.where(F.col("set_id").isNotNull()).withColumnRenamed("set_id", "id")
    if "members" in sets.columns:
        return some.select("id", F.col("members").alias("s"))
    return stored(some.groupBy("id").agg(F.collect_set("member").alias("s")), "sized")


def _contained(whole: DataFrame, share: float) -> DataFrame:
    """The pairs of ``contained_pairs`` from stored (id, s)."""
    each = whole.select("id", F.size("s").alias("n"), F.explode("s").alias("member"))
    df = each.groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    listed = F.when(F.col("df") <= HUB, F.col("df")).otherwise(0).cast("double")
    rows, made, most = df.agg(F.sum("df"), F.sum(listed * (listed - 1) / 2), F.max("df")).first()
    hubs = stored(df.where(F.col("df") > HUB), "hubs") if (most or 0) > HUB else None
    rare = each if hubs is None else each.join(hubs, "member", "left_anti")
    # dealt before they are listed: lists are not begun, sorted and spilled where sets are read
    lists = rare.repartition(_tasks(whole.sparkSession, rows or 0), "member").groupBy("member").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("of"))
    tails = lists.select(F.posexplode("of").alias("i", "e"), F.col("of.id").alias("ids")).select(F.col("e.id").alias("s"), F.col("e.n").alias("ns"), F.slice("ids", F.col("i") + 2, F.size("ids")).alias("ls"))
    spread = tails.where(F.size("ls") > 0).repartition(_tasks(whole.sparkSession, made or 0), "s").select("s", "ns", F.explode("ls").alias("l"))
    counted = spread.groupBy("s", "ns", "l").agg(F.count(F.lit(1)).cast("int").alias("both"))
    need = F.ceil(F.col("ns") * share - 1e-9)
    pairs = counted.where(F.col("both") >= need) if hubs is None else _with_hubs(counted, each.join(hubs, "member"), need)
    return pairs.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), F.round(F.col("both") / F.col("ns"), 6).alias("overlap"))


def _with_hubs(counted: DataFrame, named: DataFrame, need: Column) -> DataFrame:
    """(s, ns, l, both): pairs that share ``need`` members, from what they share of rare ones and the sets' (id, n, member, df) of frequent ones."""
    lists = stored(named.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "member"))).alias("h")), "frequent")
    of = lambda e: lists.select(F.col("id").alias(e), F.col("h").alias(f"h{e}"))
    none = F.array().cast(lists.schema["h"].dataType)
    some = counted.join(of("s"), "s", "left").withColumn("hs", F.coalesce("hs", none)).where(F.col("both") + F.size("hs") >= need).join(of("l"), "l", "left")
    rare = stored(some.select("s", "ns", "l", (F.col("both") + F.size(F.array_intersect("hs", F.coalesce("hl", none)))).alias("both")).where(F.col("both") >= need), "contained")
    place = lambda e: lists.select(F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.size("h").alias(f"k{e}"), F.posexplode("h").alias(f"at_{e}", "member"))
    first = lambda e: (F.col(f"k{e}") >= need) & (F.col(f"at_{e}") < F.col(f"k{e}") - need + decide(need))
    bigger = (F.col("nl") > F.col("ns")) | ((F.col("nl") == F.col("ns")) & (F.col("l") > F.col("s")))
    met = place("s").where(first("s")).join(place("l").hint("merge"), "member").where(bigger & first("l"))
    few = met.groupBy("s", "ns", "l").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= decide(need)).select("s", "ns", "l")
    other = few.join(rare, ["s", "l"], "left_anti").join(of("s"), "s").join(of("l"), "l")
    return rare.unionByName(other.select("s", "ns", "l", F.size(F.array_intersect("hs", "hl")).alias("both")).where(F.col("both") >= need))


def deduplicated(communities: DataFrame, sets: DataFrame, share: float = OVERLAP, outlets: int = LEAST_OUTLETS, members: int = LEAST_MEMBERS) -> DataFrame:
    """(set_id, taken) of the communities with enough support: in order of rank, those that overlap none taken before.

    ``communities`` has (set_id, rank, outlets, members), rank ascending and unique.
    """
    backed = stored(communities.where((F.col("outlets") >= outlets) & (F.col("members") >= members)).select("set_id", "rank"), "backed")
    pairs = stored(_contained(stored(_grouped(sets).join(backed.select(F.col("set_id").alias("id")), "id", "left_semi"), "sized"), share), "overlaps")
    claims = pairs.select(F.explode(F.array("a", "b")).alias("set_id"), F.struct("a", "b").alias("cell")).join(backed, "set_id")
    taken = first_come(claims, "set_id", "cell", "rank")
    return backed.join(taken, "set_id", "left").select("set_id", F.coalesce("taken", F.lit(True)).alias("taken"))


#: What makes two stories one by cast: the share of all their names, and the weight of those they share.
CAST_SHARE = 0.5
CAST_WEIGHT = 0.12


def weighted_pairs(names: DataFrame, floor: float = CAST_WEIGHT) -> DataFrame:
    """(a, b, weight): sets a < b whose shared names weigh at least ``floor`` together; ``names`` has (set_id, name, weight), a name's weight the same in all.

    Exact. Where one name does not reach the floor, two sets that reach it share another one
    that does so with what is lighter; sets of few names meet on the two of them that are
    heaviest. Larger sets meet on the heaviest name they share, which is beyond the light
    names that can't reach the floor together in both.
    """
    order = Window.partitionBy("set_id").orderBy("weight", F.desc("name"))
    rows = names.select("set_id", "name", "weight").where(F.col("set_id").isNotNull()).dropDuplicates(["set_id", "name"])
    placed = rows.select("set_id", "name", "weight", F.row_number().over(order).alias("at"), F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("reached"))
    casts = stored(placed.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("at", "name", "weight", "reached"))).alias("own")), "names")
    least = floor - 1e-9
    heavy = casts.select("set_id", "own", F.explode(F.filter("own", lambda x: x["reached"] >= least)).alias("z"))
    other = F.filter("own", lambda y: (y["at"] < F.col("z.at")) & (y["reached"] + F.col("z.weight") >= least))["name"]
    two = F.when(F.col("z.weight") >= least, F.array("z.name")).otherwise(other)
    keys = heavy.where(F.size("own") <= SMALL).select("set_id", F.col("z.name").alias("top"), F.explode(two).alias("next"))
    side = lambda df, e: df.withColumnRenamed("set_id", e)
    met = side(keys, "a").join(side(keys, "b").hint("merge"), ["top", "next"]).where(F.col("a") < F.col("b")).select("a", "b")
    alone = heavy.select("set_id", F.col("z.name").alias("top"), (F.size("own") > SMALL).alias("large"))
    far = side(alone.where("large").drop("large"), "a").join(side(alone, "b").hint("merge"), "top").where((F.col("a") < F.col("b")) | (F.col("a") > F.col("b")) & ~F.col("large"))
    pairs = met.unionByName(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    of = lambda e: casts.select(F.col("set_id").alias(e), F.transform("own", lambda x: F.struct(x["name"], x["weight"].alias("weight"))).alias(f"own_{e}"))
    shared = F.aggregate(F.array_intersect("own_a", "own_b"), F.lit(0.0), lambda s, x: s + x["weight"])
    sums = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.round(shared, 9).alias("weight"))
    return sums.where(F.col("weight") >= floor)


def same_stories(stories: DataFrame, members: DataFrame, cast: DataFrame, common: DataFrame) -> DataFrame:
    """(a, b, hero, members, cast, actors): pairs a < b that are one story, with what says so.

    ``stories`` has (set_id, hero), ``members`` the sets of ``contained_pairs``, ``cast`` (set_id, name) and
    ``common`` (name, df), in how many records a name is. One hero is enough (each story is
    paired with the least of its hero's), or 0.6 of the smaller one's members, half of all
    names of both casts, or shared names of a weight of 0.12 by 1 / df.
    """
    least = stories.where(F.col("hero").isNotNull()).groupBy("hero").agg(F.min("set_id").alias("a"))
    heroes = stories.join(least, "hero").where(F.col("a") < F.col("set_id")).select("a", F.col("set_id").alias("b"))
    names = stored(cast.select("set_id", "name").distinct(), "cast")
    alike = jaccard_pairs(names.select(F.lit(0).alias("group"), F.col("set_id").alias("id"), F.col("name").alias("term")), CAST_SHARE)
    weights = names.join(common.where(F.col("df") > 0).select("name", (1.0 / F.col("df")).alias("weight")), "name")
    found = {"hero": heroes, "members": contained_pairs(members), "cast": alike, "actors": weighted_pairs(weights)}
    flags = [df.select("a", "b", *[F.lit(k == n).alias(n) for n in found]) for k, df in found.items()]
    every = flags[0].unionByName(flags[1]).unionByName(flags[2]).unionByName(flags[3])
    return every.groupBy("a", "b").agg(*[F.bool_or(n).alias(n) for n in found])
