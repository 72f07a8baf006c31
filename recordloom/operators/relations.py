"""Joins, aggregates and set operations that the reports and the matching share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def co_occurrence(pairs: DataFrame, group: str, item: str, top: int | None = None, salt: int = 1) -> DataFrame:
    """a < b and the number of groups that hold both items.

    ``pairs`` is distinct (group, item). ``top`` keeps the most frequent items first (a
    report's feature, not a guard). With ``salt`` over 1 a group's left side is dealt over
    that many tasks and its right side copied to each, for groups with very many items.
    """
    rows = pairs.select(group, item)
    if top is not None:
        keep = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), item).limit(top).select(item)
        rows = rows.join(keep, item, "left_semi").select(group, item)
    left, right = rows.withColumnRenamed(item, "a"), rows.withColumnRenamed(item, "b")
    keys = [group]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(salt)))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys.append("_salt")
    return left.join(right, keys).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def document_frequency(pairs: DataFrame, group: str, item: str) -> DataFrame:
    """item, df: distinct groups that hold it."""
    return pairs.groupBy(item).agg(F.countDistinct(group).alias("df"))


def semi_reduced(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Only the rows an aggregation will need: a semi-join before it, not a filter after."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct unordered pairs a < b."""
    return edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col("a") != F.col("b")).distinct()


def touching(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges with either end among ``nodes``: two equi-joins and a distinct union, not an OR."""
    n = nodes.select(node)
    one = edges.join(n, edges[src] == n[node], "left_semi")
    two = edges.join(n, edges[dst] == n[node], "left_semi")
    return one.unionByName(two).distinct()


def band_join(left: DataFrame, right: DataFrame, key: list[str], at_left: str, at_right: str, width_seconds: int) -> DataFrame:
    """Pairs with equal ``key`` whose times are at most ``width_seconds`` apart.

    Times fall into buckets of that width; a right row is copied to its bucket and both
    neighbours, so the join is an equi-join whatever the table's size.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width_seconds * 1_000_000)).cast("long")
    a = left.withColumn("_b", bucket(at_left))
    b = right.withColumn("_b", F.explode(F.array(bucket(at_right) - 1, bucket(at_right), bucket(at_right) + 1)))
    apart = F.abs(F.unix_micros(F.col(at_left).cast("timestamp")) - F.unix_micros(F.col(at_right).cast("timestamp")))
    return a.join(b, [*key, "_b"]).where(apart <= width_seconds * 1_000_000).drop("_b")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, value: str, tie: str) -> DataFrame:
    """Each left row with the last ``value`` of its key at or before its time: one window over the union."""
    a = left.select(*left.columns, F.col(at_left).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("long").alias("_tie"))
    b = right.select(*[F.col(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(at_right).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(tie).cast("long").alias("_tie"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("as_of_value", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == 1).select(*left.columns, "as_of_value")


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays as sets; null if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def redirect_roots(links: DataFrame, most_hops: int = 8) -> DataFrame:
    """id, root, hops: the end of each redirect chain, at most ``most_hops`` away; a cycle ends where it began.

    ``links`` is (id, target). Each round is one equi-join that doubles the reach.
    """
    walk = links.select("id", F.col("target").alias("root"), F.lit(1).alias("hops"))
    reach = 1
    while reach < most_hops:
        step = walk.select(F.col("id").alias("_i"), F.col("root").alias("_r"), F.col("hops").alias("_h"))
        walk = walk.join(step, (walk.root == step._i) & (step._i != walk.id), "left").select(
            "id", F.coalesce("_r", "root").alias("root"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops")
        )
        reach *= 2
    return walk


def ancestors(path: Column, sep: str = ".") -> Column:
    """All prefixes of a dotted path, itself included."""
    parts = F.split(path, "[" + sep + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
