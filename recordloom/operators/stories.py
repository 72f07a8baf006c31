"""Matching, story graphs and clustering-quality scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.components import connected_components
from recordloom.storage import stored

#: Actors named by more records than this are counted apart, by lists of the records' own.
HUB_DF = 256
#: Pairs that one task counts.
TASK_PAIRS = 1_000_000


def _casts(mentions: DataFrame, least_shared: int, floor: float, hub_shared: int | None, hub_df: int) -> DataFrame:
    """event_id, own: the actors of each record that others name too, most frequent first, stored; ``decides`` says which can make a pair (``shared_actors``)."""
    df = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    inv, order = 1.0 / F.col("df"), Window.partitionBy("event_id").orderBy(F.desc("df"), "entity_id")
    nth, sums = F.row_number().over(order), F.sum(inv).over(order.rowsBetween(Window.unboundedPreceding, 0))
    least = F.when(F.col("df") > hub_df, F.lit(hub_shared or least_shared)).otherwise(F.lit(least_shared))
    rows = mentions.join(df, "entity_id").select("event_id", nth.alias("nth"), "entity_id", "df", ((nth >= least) & (sums >= floor - 1e-9)).alias("decides"))
    own = F.sort_array(F.collect_list(F.struct("nth", "entity_id", "df", "decides")))
    # filtered behind the join: else the mentions would be read and dealt twice
    return stored(rows.groupBy("event_id").agg(own.alias("own")), "casts").where(F.col("event_id").isNotNull())


def _met(lists: DataFrame, keys: list[str], split: Column | None, both_ways: bool) -> DataFrame:
    """keys, a, bs: each record of a list with those that follow it (all, if ``both_ways``); where ``split`` holds, a key's lists meet each other too."""
    met = lists.select(*keys, F.posexplode("bs").alias("i", "a"), "bs").select(*keys, "a", F.col("bs") if both_ways else F.slice("bs", F.col("i") + 2, F.size("bs")).alias("bs"))
    if split is not None:
        parts = lists.where(split)
        far = parts.select(*keys, "slot", F.col("bs").alias("as")).join(parts.select(*keys, F.col("slot").alias("other"), "bs"), keys)
        far = far.where(F.col("slot") != F.col("other")).select(*keys, "bs", F.explode("as").alias("a"))
        met = met.unionByName(far.select(*keys, "a", F.col("bs") if both_ways else F.filter("bs", lambda b: b > F.col("a")).alias("bs")))
    return met.where(F.size("bs") > 0)


def _tasks(spark, rows: float) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_PAIRS))


def _together(casts: DataFrame, hub_df: int) -> DataFrame:
    """y, df_y, z, df_z, n, slot, bs: two actors that n > 1 records name together, z one that decides in each, with those records, many of them in several lists.

    A record travels to each actor that decides with the actors before it, and is spread
    there; to a hub it goes once for each of them.
    """
    z = casts.select("event_id", "own", F.explode(F.filter("own", lambda x: x["decides"] & (x["nth"] > 1))).alias("z"))
    ys = F.transform(F.slice("own", 1, F.col("z.nth") - 1), lambda x: F.struct(x["entity_id"].alias("y"), x["df"].alias("df_y")))
    z = z.select("event_id", F.col("z.entity_id").alias("z"), F.col("z.df").alias("df_z"), ys.alias("ys"))
    whole, apart = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("ys"))), F.transform("ys", lambda y: F.struct(F.xxhash64(y["y"]).alias("part"), F.array(y).alias("ys")))
    dealt = z.select("event_id", "z", "df_z", F.inline(F.when(F.col("df_z") <= 2 * max(1, hub_df), whole).otherwise(apart))).repartition("z", "part")
    two = dealt.select("event_id", "z", "df_z", "part", F.inline("ys")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("z", "part", "y"))).where(F.col("n") > 1)
    slot = F.pmod(F.xxhash64("event_id"), F.ceil(F.col("n") / (2 * max(1, hub_df))))
    return two.groupBy("y", "df_y", "z", "df_z", "n", slot.alias("slot")).agg(F.sort_array(F.collect_list("event_id")).alias("bs"))


def shared_actors(mentions: DataFrame, keep: Column, least_shared: int = 1, floor: float = 0.0, hub_shared: int | None = None, hub_df: int = HUB_DF, both_ways: bool = False) -> DataFrame:
    """a < b, shared, weight, rarest: pairs of records that share actors, as far as ``keep`` holds.

    ``mentions`` is distinct (event_id, entity_id); an actor weighs 1/df. ``keep`` must imply
    ``least_shared`` shared actors (``hub_shared`` if all of them are hubs) of at least
    ``floor`` in weight. So of a record's actors, most frequent first, those can't make a
    pair alone that come before the ``least_shared``-th or before the weights add up to
    ``floor``: no pair is made on them. Pairs are either made on all actors but hubs, and
    the hubs' share is added from the records' lists, or, where that makes far fewer, on
    the decisive actors alone and counted from the lists altogether. Where two actors have
    to be shared and records name few, pairs are made only where two actors meet again.
    Actors named once can't link anything and never reach the join.

    Actors' lists of records travel to each record that they name and are spread into pairs
    only there, in as many tasks as the pairs need. ``both_ways`` gives each pair as (b, a)
    too, dealt by the first.
    """
    return _linked(_casts(mentions, least_shared, floor, hub_shared, hub_df), keep, least_shared, hub_df, both_ways)


def _linked(casts: DataFrame, keep: Column, least_shared: int, hub_df: int, both_ways: bool) -> DataFrame:
    """The pairs of ``shared_actors`` from the records' casts."""
    rows, inv = casts.select("event_id", F.inline("own")), 1.0 / F.col("df")
    k = rows.groupBy("entity_id").agg(F.sum(F.col("decides").cast("double")).alias("k"), F.max("df").cast("double").alias("df"))
    square = lambda c: F.col(c) * F.col(c)
    few, many, within = k.agg(F.sum(square("k")), F.sum(square("df")), F.sum(F.when(F.col("df") <= hub_df, square("df")).otherwise(square("k")))).first()
    cut = 0 if 8 * (few or 0) < (many or 0) else hub_df
    made = ((few if cut == 0 else within) or 0) / (1 if both_ways else 2)
    if least_shared > 1 and 4 * (rows.where("decides").agg(F.sum(F.col("nth") - 1)).first()[0] or 0) < made:
        lists = stored(_together(casts, hub_df), "together")
        again, slots = lists.agg(F.sum(F.size("bs") * F.col("n").cast("double")), F.max("slot")).first()
        if 4 * (again or 0) < made:
            met = _met(lists, ["y", "df_y", "z", "df_z"], F.col("n") > 2 * max(1, hub_df) if slots else None, both_ways)
            # the rarest that two records share decides in both and meets all others they share, so each of these is found
            actor = F.inline(F.array(*[F.struct(F.col(x).alias("entity_id"), F.col(f"df_{x}").alias("df")) for x in "yz"]))
            pairs = met.repartition(_tasks(casts.sparkSession, 2 * (again or 0)), "a").select("a", F.explode("bs").alias("b"), "y", "df_y", "z", "df_z").where(F.col("a") != F.col("b"))
            both = pairs.select("a", "b", actor).distinct()
            return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(inv).alias("weight"), F.max(inv).alias("rarest")).where(keep)
    side = rows.where((F.col("df") <= cut) | F.col("decides"))
    # the records of a list that would be longer are dealt into several
    slot, split = F.pmod(F.xxhash64("event_id"), F.ceil(F.col("df") / (2 * max(1, hub_df)))), F.col("df") > 2 * max(1, hub_df)
    listed_by = side.groupBy("entity_id", "df", slot.alias("slot")).agg(F.sort_array(F.collect_list("event_id")).alias("bs"))
    met = _met(listed_by, ["entity_id", "df"], split if side.where(split).take(1) else None, both_ways).select("a", "df", "bs")
    pairs = met.repartition(_tasks(casts.sparkSession, made), "a").select("a", "df", F.explode("bs").alias("b")).where(F.col("a") != F.col("b"))
    counted = F.col("df") <= cut
    out = pairs.groupBy("a", "b").agg(
        F.sum(F.when(counted, 1).otherwise(0)).alias("shared"), F.sum(F.when(counted, inv).otherwise(0.0)).alias("weight"), F.max(F.when(counted, inv).otherwise(0.0)).alias("rarest")
    )
    if cut == 0 or rows.where(F.col("df") > cut).take(1):
        lists = casts.select("event_id", F.transform(F.filter("own", lambda x: x["df"] > cut), lambda x: F.struct(x["df"], x["entity_id"])).alias("own")).where(F.size("own") > 0)
        lists = stored(lists, "lists")
        for side_ in "ab":
            out = out.join(lists.select(F.col("event_id").alias(side_), F.col("own").alias(f"own_{side_}")), side_, "left")
        both = F.coalesce(F.array_intersect("own_a", "own_b"), F.array().cast(lists.schema["own"].dataType))
        out = out.withColumn("both", both).select(
            "a", "b", (F.col("shared") + F.size("both")).alias("shared"),
            (F.col("weight") + F.aggregate("both", F.lit(0.0), lambda s, x: s + 1.0 / x["df"])).alias("weight"),
            F.greatest(F.col("rarest"), F.aggregate("both", F.lit(0.0), lambda s, x: F.greatest(s, 1.0 / x["df"]))).alias("rarest"),
        )
    return out.where(keep)


def actor_edges(mentions: DataFrame, floor: float, least_shared: int = 2) -> DataFrame:
    """a < b, shared, weight: records that share enough rare actors (weight is the sum of 1/df)."""
    keep = (F.col("shared") >= least_shared) & (F.col("weight") >= floor)
    return shared_actors(mentions, keep, least_shared, floor).select("a", "b", "shared", "weight")


def edge_union(first: DataFrame, second: DataFrame, scale: float) -> DataFrame:
    """a < b, weight: the first list's weight plus ``scale`` times the second's."""
    x = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").alias("_x"))
    y = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").alias("_y"))
    return x.join(y, ["a", "b"], "full").select("a", "b", (F.coalesce("_x", F.lit(0.0)) + scale * F.coalesce("_y", F.lit(0.0))).alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """event_id, component of every record that has an edge."""
    return connected_components(edges, "a", "b").select(F.col("node").alias("event_id"), F.col("root").alias("component"))


def first_hit(candidates: DataFrame, key: str, match: str) -> DataFrame:
    """The strongest tier's best candidate of each key: tier up, score down, id up."""
    order = Window.partitionBy(key).orderBy("tier", F.desc("score"), match)
    return candidates.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def story_roots(members: DataFrame) -> DataFrame:
    """component, root: the member with most outlets, then the earliest, then the lowest id."""
    first = F.min_by("event_id", F.struct(-F.col("outlets"), F.col("at"), F.col("event_id")))
    return members.groupBy("component").agg(first.alias("root"))


def branch_parents(members: DataFrame, affinity: DataFrame, roots: DataFrame) -> DataFrame:
    """event_id, parent_id: each member's earlier member of greatest affinity over its mean pull on all others; the root has none.

    ``members`` is (event_id, component, at), ``affinity`` is (a, b, weight), undirected. A
    member without affinity to an earlier one hangs on the earliest, the earliest on the root.
    """
    both = affinity.select("a", "b", "weight").unionByName(affinity.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("at", "event_id")).alias("earliest"))
    child = members.select(F.col("event_id").alias("a"), "component", F.col("at").alias("at_a"))
    other = members.select(F.col("event_id").alias("b"), F.col("component").alias("_c"), F.col("at").alias("at_b"))
    pairs = both.join(child, "a").join(other, "b").where(F.col("component") == F.col("_c")).join(size.select("component", "n"), "component")
    pull = pairs.groupBy("b").agg((F.sum("weight") / (F.first("n") - 1)).alias("pull"))
    earlier = pairs.where(F.struct("at_b", "b") < F.struct(F.col("at_a").alias("at_b"), F.col("a").alias("b"))).join(pull, "b")
    force = F.round(F.col("weight") / F.col("pull"), 9)
    best = earlier.groupBy("a").agg(F.min_by("b", F.struct(-force, F.col("at_b"), F.col("b"))).alias("best"))
    rows = members.join(best, members.event_id == best.a, "left").join(size, "component").join(roots, "component")
    parent = F.when(F.col("event_id") == F.col("root"), None).otherwise(F.coalesce("best", F.when(F.col("event_id") != F.col("earliest"), F.col("earliest")).otherwise(F.col("root"))))
    return rows.select("event_id", "component", parent.alias("parent_id"))


def off_spine(members: DataFrame, roots: DataFrame, mentions: DataFrame, least: float) -> DataFrame:
    """event_id, off_spine: members whose actors carry less than ``least`` of their root's weight (1/df each)."""
    df = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("df"))
    spine = roots.join(mentions, roots.root == mentions.event_id).select("component", "entity_id").join(df, "entity_id")
    own = members.select("event_id", "component").join(mentions, "event_id").join(spine, ["component", "entity_id"])
    weight = own.groupBy("event_id").agg(F.sum(1.0 / F.col("df")).alias("w"))
    return members.select("event_id").join(weight, "event_id", "left").select("event_id", (F.round(F.coalesce("w", F.lit(0.0)), 9) < least).alias("off_spine"))


def tree_depths(parents: DataFrame) -> DataFrame:
    """event_id, depth: steps to the root, by rounds that double the reach of each step."""
    walk = stored(parents.select("event_id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("depth")), "walk")
    while walk.where(F.col("up").isNotNull()).take(1):
        step = walk.select(F.col("event_id").alias("_e"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        walk = stored(walk.join(step, walk.up == step._e, "left").select("event_id", F.col("_u").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")), "walk")
    return walk.select("event_id", "depth")


def bounded_reach(edges: DataFrame, seeds: DataFrame, depth: int, floor: float, decay: float = 1.0) -> DataFrame:
    """seed, event_id, hops: records within ``depth`` steps whose decayed path strength stays at the floor."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    seen = seeds.select(F.col("event_id").alias("seed"), "event_id", F.lit(0).alias("hops"), F.lit(1.0).alias("strength"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(both, front.event_id == both.a).select("seed", F.col("b").alias("event_id"), F.lit(hop).alias("hops"), (F.col("strength") * F.least("weight", F.lit(1.0)) * decay).alias("strength"))
        step = step.where(F.col("strength") >= floor).groupBy("seed", "event_id", "hops").agg(F.max("strength").alias("strength"))
        front = step.join(seen.select("seed", "event_id"), ["seed", "event_id"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def _best_moves(edges: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """id, best, alone: the neighbouring community of greatest constant-Potts gain, for nodes that gain by moving.

    ``nodes`` is (id, size, c, within); ``edges`` is (a, b, w), both ways. Only communities of
    the same ``within`` are open to a node. ``alone`` is true where a node shares its own with none.
    """
    links = edges.join(nodes.select(F.col("id").alias("b"), "c", F.col("within").alias("_in")), "b").groupBy("a", "c", "_in").agg(F.sum("w").alias("w"))
    sizes = nodes.groupBy("c").agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("k"))
    own = nodes.select(F.col("id").alias("a"), "size", F.col("c").alias("own"), "within").join(sizes.select(F.col("c").alias("own"), F.col("all").alias("own_all"), F.col("k").alias("own_k")), "own")
    options = links.join(own, "a").where(F.col("within") == F.col("_in")).join(sizes, "c")
    stays = F.col("c") == F.col("own")
    gain = F.round(F.col("w") - resolution * F.col("size") * (F.col("all") - F.when(stays, F.col("size")).otherwise(0)), 9)
    apart = F.round(-resolution * F.col("size") * (F.col("own_all") - F.col("size")), 9)
    scored = options.select("a", "c", gain.alias("gain"), stays.alias("stays"), apart.alias("apart"), (F.col("own_k") == 1).alias("alone"))
    best = scored.groupBy("a").agg(
        F.max(F.when(~F.col("stays"), F.struct("gain", (-F.col("c")).alias("c")))).alias("to"), F.coalesce(F.max(F.when(F.col("stays"), F.col("gain"))), F.first("apart")).alias("now"), F.first("alone").alias("alone")
    )
    return best.where(F.col("to").isNotNull() & (F.col("to.gain") > F.col("now") + 1e-8)).select(F.col("a").alias("id"), (-F.col("to.c")).alias("best"), "alone")


def _moved(edges: DataFrame, nodes: DataFrame, resolution: float, rounds: int, merge_only: bool = False) -> DataFrame:
    """``nodes`` after rounds of moves, in each of which a hashed half may move.

    With ``merge_only`` nodes move once, from a community of their own to one whose name does
    not belong to the moving half, so nothing leaves what others joined.
    """
    for n in range(rounds):
        half = lambda c, n=n: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(2))
        wants, turn = F.col("best").isNotNull(), half("id") == 0
        if merge_only:
            wants, turn = wants & F.col("alone") & F.col("may"), turn & (half("best") == 1)
        found = nodes.join(_best_moves(edges, nodes, resolution), "id", "left").withColumn("wants", F.coalesce(wants, F.lit(False)))
        nodes = stored(found.withColumn("c", F.when(F.col("wants") & turn, F.col("best")).otherwise(F.col("c"))).drop("best", "alone"), "nodes")
        going = nodes.where("wants").take(1)
        nodes = nodes.drop("wants")
        if not going:
            break
    return nodes


def communities(edges: DataFrame, resolution: float = 0.05, levels: int = 4, rounds: int = 10) -> DataFrame:
    """event_id, community: constant-Potts communities by the Leiden method, named by their smallest member.

    Each level moves nodes between communities, refines every community into well-connected
    parts that begin as single nodes, and makes the parts the next level's nodes. All steps
    are grouped sums and joins, so no component has to fit one task.
    """
    one = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("w")).where(F.col("a") != F.col("b"))
    links = stored(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "links")
    nodes = stored(links.select(F.col("a").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("size"), F.col("id").alias("c"), F.lit(0).alias("within")), "nodes")
    names = nodes.select(F.col("id").alias("event_id"), "id")
    for _ in range(levels):
        nodes = _moved(links, nodes, resolution, rounds)
        # a part may leave its singleton only if the rest of the community holds it well
        inner = links.join(nodes.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(nodes.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where(F.col("ca") == F.col("cb"))
        pull = inner.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("pull"))
        total = nodes.groupBy("c").agg(F.sum("size").alias("all"))
        may = F.coalesce("pull", F.lit(0.0)) >= resolution * F.col("size") * (F.col("all") - F.col("size")) - 1e-9
        start = nodes.join(pull, "id", "left").join(total, "c").select("id", "size", F.col("id").alias("c"), F.col("c").alias("within"), may.alias("may"))
        parts = _moved(links, stored(start, "start"), resolution, rounds, merge_only=True)
        names = stored(names.join(parts.select("id", F.col("c").alias("_c")), "id").select("event_id", F.col("_c").alias("id")), "names")
        fewer = stored(parts.groupBy(F.col("c").alias("id")).agg(F.sum("size").alias("size"), F.min("within").alias("c")).withColumn("within", F.lit(0)), "nodes")
        if fewer.count() == nodes.count():
            break
        ends = parts.select("id", "c")
        links = links.join(ends.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(ends.select(F.col("id").alias("b"), F.col("c").alias("y")), "b").where(F.col("x") != F.col("y"))
        links = stored(links.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "links")
        nodes = fewer
    found = names.join(nodes.select("id", "c"), "id")
    least = found.groupBy("c").agg(F.min("event_id").alias("community"))
    return found.join(least, "c").select("event_id", "community")


def seed_communities(edges: DataFrame, reach: DataFrame, most: int = 30) -> DataFrame:
    """seed, event_id: the seed's community by greedy modularity among the ``most`` first records of its reach.

    ``reach`` is (seed, event_id, hops), as ``bounded_reach`` makes it, so a group is bounded;
    of equal gains the communities with the smaller members merge first.
    """
    near = reach.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("hops", "event_id"))).where(F.col("_n") <= most).select("seed", "event_id")
    ends = [near.select("seed", F.col("event_id").alias(c)) for c in "ab"]
    own = edges.select("a", "b", "weight").join(ends[0], "a").join(ends[1], ["seed", "b"]).select("seed", "a", "b", "weight")

    def run(pdf):
        import pandas as pd

        seed = int(pdf["seed"].iloc[0])
        between: dict[tuple[int, int], float] = {}
        degree: dict[int, float] = {}
        for a, b, w in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["weight"].tolist(), strict=True):
            between[min(a, b), max(a, b)] = between.get((min(a, b), max(a, b)), 0.0) + w
            degree[a], degree[b] = degree.get(a, 0.0) + w, degree.get(b, 0.0) + w
        total, group = sum(between.values()), {v: [v] for v in degree}
        while between:
            gain = {p: w / total - degree[p[0]] * degree[p[1]] / (2 * total * total) for p, w in between.items()}
            x, y = min(gain, key=lambda p: (-round(gain[p], 12), p))
            if gain[x, y] <= 1e-12:
                break
            group[x] += group.pop(y)
            degree[x] += degree.pop(y)
            joined: dict[tuple[int, int], float] = {}
            for (a, b), w in between.items():
                a, b = (x if a == y else a), (x if b == y else b)
                if a != b:
                    joined[min(a, b), max(a, b)] = joined.get((min(a, b), max(a, b)), 0.0) + w
            between = joined
        mine = next((g for g in group.values() if seed in g), [seed])
        return pd.DataFrame([(seed, v) for v in sorted(mine)], columns=["seed", "event_id"])

    return own.groupBy("seed").applyInPandas(run, "seed long, event_id long")


def star_merge(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """survivor, member: members join the best-ranked survivor only on their own verdict with it.

    ``pairs`` is (a, b) of accepted verdicts; ``nodes`` is (event_id, outlets, at); survivors
    lead by outlets, then time, then id. In each round the records are decided whose better
    neighbours all are: beside a survivor a record joins the best one, else it survives.
    """
    rank = nodes.select(F.col("event_id").alias("id"), F.struct((-F.col("outlets")).alias("o"), F.col("at").alias("t"), F.col("event_id").alias("i")).alias("rank"))
    ends = [rank.select(F.col("id").alias(c), F.col("rank").alias(f"r{c}")) for c in "ab"]
    both = pairs.select("a", "b").where(F.col("a") != F.col("b")).distinct().join(ends[0], "a").join(ends[1], "b")
    first = F.col("ra") < F.col("rb")
    edges = stored(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("up"), F.when(first, F.col("ra")).otherwise(F.col("rb")).alias("rank"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("low")).distinct(), "verdicts")
    state = stored(edges.select(F.col("up").alias("id")).union(edges.select("low")).distinct().withColumn("into", F.lit(None).cast("long")), "state")
    while state.where(F.col("into").isNull()).take(1):
        above = edges.join(state.withColumnRenamed("id", "up").withColumnRenamed("into", "up_into"), "up")
        told = above.groupBy(F.col("low").alias("id")).agg(
            F.min(F.when(F.col("up_into") == F.col("up"), F.struct("rank", "up"))).alias("best"), F.count_if(F.col("up_into").isNull()).alias("open"),
            F.min(F.when(F.col("up_into").isNull(), F.col("rank"))).alias("open_rank"),
        )
        # an undecided neighbour that ranks behind the best survivor changes nothing
        settled = F.col("best").isNotNull() & (F.col("open_rank").isNull() | (F.col("best.rank") < F.col("open_rank")))
        into = F.when(settled, F.col("best.up")).when(F.coalesce("open", F.lit(0)) == 0, F.col("id"))
        state = stored(state.join(told, "id", "left").select("id", F.coalesce("into", into).alias("into")), "state")
    return state.where(F.col("into") != F.col("id")).select(F.col("into").alias("survivor"), F.col("id").alias("member"))


def b_cubed(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """precision, recall, f1 and macro purity of one labelling against another, from the contingency table."""
    cell = df.groupBy(predicted, gold).agg(F.count(F.lit(1)).alias("n"))
    cell = cell.withColumn("p", F.sum("n").over(Window.partitionBy(predicted))).withColumn("g", F.sum("n").over(Window.partitionBy(gold)))
    top = cell.groupBy(predicted).agg((F.max("n") / F.sum("n")).alias("share")).agg(F.avg("share").alias("purity"))
    n = F.col("n")
    out = cell.agg((F.sum(n * n / F.col("p")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("g")) / F.sum(n)).alias("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).crossJoin(top)


def auc(counts: DataFrame, score: str, positive: Column, n: str = "n") -> DataFrame:
    """auc: the share of (positive, negative) pairs ranked right, ties half, from ``n`` per score and class.

    Running counts need an order over the distinct scores, so callers round them.
    """
    each = counts.groupBy(score).agg(F.sum(F.when(positive, F.col(n)).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(F.col(n))).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("below", below)
    return placed.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def threshold_sweep(counts: DataFrame, score: str, positive: Column, grid: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn for each value of the grid, from ``n`` per score and class."""
    hit = F.explode(F.array(*map(F.lit, grid))).alias("threshold")
    split = counts.select(score, F.when(positive, F.col("n")).otherwise(0).alias("p"), F.when(positive, 0).otherwise(F.col("n")).alias("n"))
    counted = split.groupBy(score).agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select(score, "p", "n", hit)
    over = F.col(score) >= F.col("threshold") - 1e-9
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return counted.groupBy("threshold").agg(total("p", over).alias("tp"), total("n", over).alias("fp"), total("p", ~over).alias("fn"), total("n", ~over).alias("tn"))


def detection_cost(fn: Column, fp: Column, positives: Column, negatives: Column) -> Column:
    """The unweighted form: miss rate plus four times the false-alarm rate."""
    return fn / positives + 4 * fp / negatives


def weighted_detection_cost(fn: Column, fp: Column, positives: Column, negatives: Column, prior: float = 0.02, miss: float = 1.0, alarm: float = 0.1) -> Column:
    """The prior-weighted form, normalised by the better of answering always or never."""
    return (miss * prior * fn / positives + alarm * (1 - prior) * fp / negatives) / min(miss * prior, alarm * (1 - prior))


def average_linkage(pairs: DataFrame, floor: float) -> DataFrame:
    """event_id, cluster: average-linkage clusters of mean similarity at or above the floor, named by their smallest member.

    ``pairs`` is (a, b, sim); a pair that is not listed has similarity 0. In each round all
    clusters merge that are each other's most similar one, which comes to the same tree as
    merging the most similar pair of all, as a merger is never nearer to a third cluster
    than its parts were. A round is grouped sums and joins, whatever a component's size.
    """
    one = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("total")).where(F.col("a") != F.col("b"))
    sums = stored(one, "sums")
    names = stored(sums.select(F.col("a").alias("event_id")).union(sums.select("b")).distinct().withColumn("cluster", F.col("event_id")), "names")
    while True:
        size = names.groupBy(F.col("cluster").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        sized = sums.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        near = sized.select("a", "b", F.round(F.col("total") / (F.col("na") * F.col("nb")), 12).alias("mean")).where(F.col("mean") >= floor)
        either = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean"))
        best = either.groupBy("a").agg(F.min_by("b", F.struct(-F.col("mean"), F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
        back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merged = stored(best.join(back, ["a", "b"]).where(F.col("a") < F.col("b")).select(F.col("b").alias("old"), F.col("a").alias("new")), "merged")
        if not merged.take(1):
            return names
        renamed = lambda df, c: df.join(merged, df[c] == merged["old"], "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        names = stored(renamed(names, "cluster"), "names")
        moved = renamed(renamed(sums, "a"), "b").where(F.col("a") != F.col("b"))
        sums = stored(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total")), "sums")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p = hits / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def related(members: DataFrame, mentions: DataFrame, floor: float, k: int) -> DataFrame:
    """event_id, other_id, weight, rnk: the k records that share most rare actors with each asked one.

    Records that share two actors are pairs. Of those that share one alone only the k of least
    id can be among the k best, and none of them if a rarer actor names k others already.
    """
    casts = _casts(mentions, 2, floor - 5e-7, None, HUB_DF)
    many = _linked(casts, (F.col("shared") >= 2) & (F.round("weight", 6) >= floor), 2, HUB_DF, True).select("a", "b", F.round("weight", 6).alias("weight"))
    order = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    many = many.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("a", F.array("b").alias("bs"), "weight")
    weight = lambda df: F.round(1.0 / F.col(df), 6)
    # one of its df records is the asked one, another may have no id
    rarer = F.array_min(F.transform(F.filter("own", lambda x: x["df"] > k + 1), lambda x: x["df"]))
    rows = casts.select("event_id", rarer.alias("rarer"), F.inline("own")).where(weight("df") >= floor)
    rows = rows.select("event_id", "entity_id", "df", (F.col("rarer").isNull() | (weight("df") >= weight("rarer"))).alias("asks"))
    named = Window.partitionBy("entity_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.array_compact(F.array(*[F.nth_value("event_id", n).over(named) for n in range(1, k + 2)]))
    one = rows.withColumn("bs", first).where("asks").select(F.col("event_id").alias("a"), "bs", weight("df").alias("weight"))
    dealt = many.unionByName(one).repartition(_tasks(mentions.sparkSession, (k + 1) * rows.where("asks").count()), "a")
    pairs = dealt.select(F.col("a"), F.explode("bs").alias("b"), "weight").where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    pairs = pairs.select(F.col("a").alias("event_id"), F.col("b").alias("other_id"), "weight")
    order = Window.partitionBy("event_id").orderBy(F.desc("weight"), "other_id")
    best = pairs.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    # an inner join, which stays behind the cut to k rows
    return best.join(members.select("event_id").distinct(), "event_id")


def entity_folds(named: DataFrame) -> DataFrame:
    """entity_id, target, why: entities of (entity_id, kind, key, ident) that are another one's variant.

    Entities of one kind and key are one, the least id standing for it, unless they carry
    different identifiers; then only those with the same identifier are.
    """
    group = named.groupBy("kind", "key").agg(F.countDistinct("ident").alias("idents"), F.min("entity_id").alias("least"))
    known = named.where(F.col("ident").isNotNull()).groupBy("kind", "key", "ident").agg(F.min("entity_id").alias("same"))
    rows = named.join(group, ["kind", "key"]).join(known, ["kind", "key", "ident"], "left")
    one = F.col("idents") <= 1
    folds = rows.select("entity_id", F.when(one, F.col("least")).otherwise(F.col("same")).alias("target"), F.when(one, "name").otherwise("identifier").alias("why"))
    return folds.where(F.col("entity_id") != F.col("target"))


def fold_entities(mentions: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with folded entities repointed and twins dropped, journal of what moved).

    The journal has (event_id, old_id, new_id, dropped); ``dropped`` marks mentions whose place was
    taken by one of a lesser id, so that ``restore_entities`` can give all of them back.
    """
    moved = stored(mentions.join(folds.select("entity_id", "target"), "entity_id", "left").select("event_id", F.col("entity_id").alias("old_id"), F.coalesce("target", "entity_id").alias("new_id")), "moved")
    first = moved.groupBy("event_id", "new_id").agg(F.min("old_id").alias("first"))
    journal = moved.where(F.col("old_id") != F.col("new_id")).join(first, ["event_id", "new_id"]).select("event_id", "old_id", "new_id", (F.col("first") < F.col("old_id")).alias("dropped"))
    return first.select("event_id", F.col("new_id").alias("entity_id")), journal


def restore_entities(folded: DataFrame, journal: DataFrame) -> DataFrame:
    """The mentions as they were before ``fold_entities``."""
    # a place was empty before if the least id that moved there met none
    made = journal.where(~F.col("dropped")).select("event_id", F.col("new_id").alias("entity_id"))
    return folded.join(made, ["event_id", "entity_id"], "left_anti").unionByName(journal.select("event_id", F.col("old_id").alias("entity_id")))
