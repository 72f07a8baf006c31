"""Connected components of an undirected edge table, without driver-side graphs.

Alternating large-star and small-star steps turn every component into a star around
its smallest node in O(log^2 n) rounds. Each round is two grouped minima (combined
map-side, so a hub costs one row per task) and two equi-joins that AQE may split, and
each round's edges are written to scratch storage so lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.storage import stored


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Self loops and rows with a null end add nothing; repeated edges count once; an empty
    table gives an empty result. Nodes may be of any orderable type.
    """
    a, b = F.col(src), F.col(dst)
    links = stored(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    seen = _digest(links)
    while seen[0]:
        links = stored(_small_star(_large_star(links)), "stars")
        now = _digest(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u points to the smallest of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its lower neighbours point to the lowest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
