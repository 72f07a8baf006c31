"""Greedy choice in order of rank, by rounds of joins.

Going through items from the best rank on and taking each one none of whose claims is
taken yet needs no loop over items: an item that is first on all of its claims is taken
whatever the others do, and all others that share a claim with it are out. What is left is
decided by the next round, so rounds are as many as the longest chain of items that depend
on one another, and rows only shrink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.storage import stored


def first_come(claims: DataFrame, item: str, cell: str, rank: str) -> DataFrame:
    """(item, taken): what choosing in ascending ``rank`` takes, for every item with a claim.

    ``claims`` has one row per item and cell it claims; ``rank`` must be unique per item and
    the same on all its rows. A cell that many items claim costs one row per claim and
    round, never a pair of items. Null cells claim nothing; repeated rows count once; an
    empty table gives an empty result.
    """
    left = stored(claims.where(F.col(cell).isNotNull()).select(item, cell, F.col(rank).alias("_rank")).distinct(), "claims")
    decided = []
    while left.take(1):
        firsts = left.groupBy(cell).agg(F.min("_rank").alias("_first"))
        wins = left.join(firsts, cell).groupBy(item).agg(F.bool_and(F.col("_rank") == F.col("_first")).alias("taken"))
        gone = left.join(wins.where("taken"), item, "left_semi").select(cell).distinct()
        lost = left.join(gone, cell, "left_semi").select(item).distinct()
        # what is taken claims only cells that are gone now, so it is among these
        round_ = stored(lost.join(wins, item), "decided")
        decided.append(round_)
        left = stored(left.join(round_, item, "left_anti"), "claims")
    if not decided:
        return left.select(item, F.lit(True).alias("taken"))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out
