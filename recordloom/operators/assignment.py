"""Stories that persist: each record joins one story when it comes, or founds one, and stays there.

The state is append-only: a batch of records is judged against all batches before it and
written to a folder of its own, so a batch that runs again replaces its own answers and a
version is all batches up to a number. Records of one batch don't see one another; stories
that they found twice are the merge pass's to fold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators import vectors as V
from recordloom.storage import stored

#: How near a member must be to propose its story, how many stories are
#: proposed, from which size on a story's centroid proposes it, days that a story moves on,
#: and the judge's floors for a story and for a running one.
FARTHEST = 0.11
CANDIDATES = 3
BIG = 20
CENTROID_CANDIDATES = 2
WINDOW_DAYS = 14
FLOOR, RUNNING_FLOOR = 0.70, 0.60
_DAY = 86_400_000_000
_HOUR = 3_600_000_000
_PLACED = "event_id long, story long, at timestamp_ntz, vector array<double>, how string, score double"


def near_stories(asks: DataFrame, held: DataFrame, k: int, farthest: float, after: int | None, digits: int = 6, block: int = V.BLOCK, before: int = WINDOW_DAYS * _DAY) -> DataFrame:
    """(event_id, story, d): each ask's ``k`` nearest stories, by the least cosine distance of a vector of theirs in its time.

    ``asks`` has (event_id, at, vector), ``held`` (story, at, vector), times in microseconds.
    A held vector counts from ``before`` to ``after`` microseconds around the ask (null:
    however late). With ``after``, which is no longer than ``before``, both sides meet by
    buckets of time as long as that; what one bucket holds and what asks there are dealt into
    blocks, and a pair of blocks returns its k best, some rows of asks at a time.
    """
    span = before
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bucket = lambda c: F.floor(c / span).cast("long")
    at = F.col("at")
    times = F.array(F.lit(0).cast("long")) if after is None else F.array_distinct(F.array(bucket(at - span), bucket(at), bucket(at + after)))
    a = asks.where(F.col("vector").isNotNull()).select(F.explode(times).alias("bucket"), "event_id", "at", "vector")
    b = held.where(F.col("vector").isNotNull()).select((F.lit(0).cast("long") if after is None else bucket(at)).alias("bucket"), "story", "at", "vector")
    fullest = lambda rows: rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n_asks, n_held = (V._blocks(fullest(x), block, 4) for x in (a, b))
    a = a.select("bucket", dealt(["event_id"], n_asks).alias("part"), every(n_held).alias("salt"), "event_id", F.lit(None).cast("long").alias("story"), "at", "vector")
    b = b.select("bucket", every(n_asks).alias("part"), dealt(["story", "at"], n_held).alias("salt"), F.lit(None).cast("long").alias("event_id"), "story", "at", "vector")

    def run(table: pa.Table) -> pa.Table:
        asked = table.filter(pa.compute.is_null(table.column("story")))
        there = table.filter(pa.compute.is_valid(table.column("story")))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(there):
            when, stories = there.column("at").to_numpy(), there.column("story").to_numpy()
            unit = V._unit(V._matrix(there.column("vector"))).T
            ids, now = asked.column("event_id").to_numpy(), asked.column("at").to_numpy()
            x, apart = V._unit(V._matrix(asked.column("vector"))), len(np.unique(stories)) == len(stories)
            step = max(1, (1 << 21) // len(there))
            for n in range(0, len(ids), step):
                far = 1.0 - np.round(x[n : n + step] @ unit, digits)
                far = np.round(far, digits) + 0.0
                ok = (far <= farthest) & (when[None, :] >= now[n : n + step, None] - span)
                if after is not None:
                    ok &= when[None, :] <= now[n : n + step, None] + after
                if apart and len(stories) > k:
                    # of stories with one vector each, those beyond the k-th distance can't count
                    far = np.where(ok, far, np.inf)
                    ok &= far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]
                i, j = np.nonzero(ok)
                d, of = far[i, j], stories[j]
                order = np.lexsort((d, of, i))
                i, d, of = i[order], d[order], of[order]
                least = np.ones(len(i), bool)
                least[1:] = (i[1:] != i[:-1]) | (of[1:] != of[:-1])
                i, d, of = i[least], d[least], of[least]
                order = np.lexsort((of, d, i))
                i, d, of = i[order], d[order], of[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((ids[n + i[first]], of[first], d[first]))
        return pa.table(dict(zip(("event_id", "story", "d"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = a.unionByName(b).groupBy("bucket", "part", "salt").applyInArrow(run, "event_id long, story long, d double")
    least = found.groupBy("event_id", "story").agg(F.min("d").alias("d"))
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("d", "story"))
    return least.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


class Assignments:
    """The placed records below ``base``, batch by batch."""

    def __init__(
        self, spark: SparkSession, base: str, scopes: DataFrame, judge: Callable[[DataFrame], DataFrame], farthest: float = FARTHEST, big: int = BIG,
        candidates: int = CANDIDATES, centroid_candidates: int = CENTROID_CANDIDATES,
    ):
        """``scopes`` has (story) of running stories; ``judge`` adds ``score`` to (event_id, story, d)."""
        self.spark, self.base, self.judge = spark, base.rstrip("/"), judge
        self.scopes = scopes.select("story").distinct().withColumn("running", F.lit(True))
        self.farthest, self.big, self.k, self.centroid_k = farthest, big, candidates, centroid_candidates

    def placed(self, batches: int) -> DataFrame:
        """event_id, story, at, vector, how, score of the first ``batches`` batches."""
        if not batches:
            return self.spark.createDataFrame([], _PLACED)
        return self.spark.read.schema(_PLACED).parquet(*[f"{self.base}/batch={n}" for n in range(batches)])

    def stories(self, placed: DataFrame) -> DataFrame:
        """story, n, since, last, running."""
        facts = placed.groupBy("story").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("since"), F.max("at").alias("last"))
        return facts.join(self.scopes, "story", "left").withColumn("running", F.coalesce("running", F.lit(False)))

    def proposed(self, records: DataFrame, placed: DataFrame, stories: DataFrame, links: DataFrame) -> DataFrame:
        """(event_id, story, d): stories of linked records first, then of near members, as many as ``candidates``; and big stories by centroid."""
        either = links.select(F.col("a").alias("event_id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("event_id"), F.col("a").alias("other")))
        linked = either.join(records.select("event_id"), "event_id", "left_semi").join(placed.select(F.col("event_id").alias("other"), "story"), "other").select("event_id", "story").distinct()
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        asks = records.select("event_id", micros("at").alias("at"), "vector")
        near = near_stories(asks, placed.select("story", micros("at").alias("at"), "vector"), self.k, self.farthest, _HOUR)
        first = linked.withColumn("d", F.lit(None).cast("double")).unionByName(near).groupBy("event_id", "story").agg(F.max(F.col("d").isNull()).alias("told"), F.min("d").alias("d"))
        nth = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("told"), F.when(~F.col("told"), F.col("d")), "story"))
        first = first.withColumn("nth", nth).where(F.col("nth") <= self.k).select("event_id", "story", F.when(~F.col("told"), F.col("d")).alias("d"))
        big = stories.where((F.col("n") >= self.big) | F.col("running")).select("story", micros("last").alias("at"))
        centres = V.centroids(placed.join(big.select("story"), "story", "left_semi"), "story", "vector").join(big, "story").select("story", "at", F.col("centroid").alias("vector"))
        central = near_stories(asks, stored(centres, "centres"), self.centroid_k, 2.0, None)
        return first.unionByName(central.join(first, ["event_id", "story"], "left_anti"))

    def run(self, n: int, records: DataFrame, links: DataFrame) -> DataFrame:
        """Place the batch ``n`` of (event_id, at, vector); ``links`` has (a, b) of verified follow-ups. Returns what it placed."""
        placed = self.placed(n)
        new = records.select("event_id", F.col("at").cast("timestamp_ntz").alias("at"), F.col("vector").cast("array<double>").alias("vector"))
        new = stored(new.dropDuplicates(["event_id"]).join(placed.select("event_id"), "event_id", "left_anti"), "records")
        stories = stored(self.stories(placed), "stories")
        judged = self.judge(stored(self.proposed(new, placed, stories, links), "proposed")).join(stories, "story")
        passing = judged.where(F.col("score") >= F.when(F.col("running"), RUNNING_FLOOR).otherwise(FLOOR))
        order = [F.desc("running"), F.desc("n"), "since", F.desc("score"), "story"]
        best = passing.withColumn("nth", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))).where(F.col("nth") == 1).select("event_id", "story", "score")
        rows = new.join(best, "event_id", "left").select(
            "event_id", F.coalesce("story", "event_id").alias("story"), "at", "vector", F.when(F.col("story").isNull(), "founded").otherwise("joined").alias("how"), "score"
        )
        rows.write.mode("overwrite").parquet(f"{self.base}/batch={n}")
        return self.spark.read.schema(_PLACED).parquet(f"{self.base}/batch={n}")
