"""Counted reports: day spines, period comparison, retention, percentiles, meters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_spine(spark, first: str, last: str) -> DataFrame:
    """day: every date from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def on_spine(spine: DataFrame, counts: DataFrame, day: str, value: str, since: Column) -> DataFrame:
    """day, value: zero on days without rows, null before counting began (missing is not zero)."""
    joined = spine.join(counts, day, "left")
    return joined.select(day, F.when(F.col(day) >= since, F.coalesce(F.col(value), F.lit(0))).alias(value))


def period_vs_previous(df: DataFrame, key: str, at: str, end: Column, days: int) -> DataFrame:
    """key, current, previous: counts of the last ``days`` days and of the same span before."""
    age = F.datediff(end, F.to_date(at))
    now, before = (age >= 0) & (age < days), (age >= days) & (age < 2 * days)
    return df.where(now | before).groupBy(key).agg(F.count_if(now).alias("current"), F.count_if(before).alias("previous"))


def retention(df: DataFrame, user: str, at: str) -> DataFrame:
    """cohort, k, users: users of each Monday week seen again k weeks later."""
    weeks = df.select(user, F.to_date(F.date_trunc("week", at)).alias("week")).distinct()
    first = weeks.groupBy(user).agg(F.min("week").alias("cohort"))
    later = weeks.join(first, user).withColumn("k", (F.datediff("week", "cohort") / 7).cast("long"))
    return later.groupBy("cohort", "k").agg(F.count(F.lit(1)).alias("users"))


def running_total(df: DataFrame, day: str, value: str, seed: int = 0) -> DataFrame:
    """Adds ``total``: the running sum over days on top of ``seed``; one row per day, so one task."""
    return df.withColumn("total", F.sum(value).over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)) + seed)


def funnel(df: DataFrame, user: str, stage: str, stages: list[str]) -> DataFrame:
    """stage, users: users that reached each stage or any later one."""
    depth = F.element_at(F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))]), F.col(stage))
    reached = df.where(F.col(stage).isin(stages)).groupBy(user).agg(F.max(depth).alias("d"))
    steps = F.explode(F.slice(F.array(*map(F.lit, stages)), F.lit(1), F.col("d") + 1))
    return reached.select(user, steps.alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("users"))


def capped_daily_unique(df: DataFrame, user: str, at: str, per_user: int) -> DataFrame:
    """day, visitors, counted: distinct users and their rows, no user counted over ``per_user``."""
    each = df.groupBy(F.to_date(at).alias("day"), user).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("day").agg(F.count(F.lit(1)).alias("visitors"), F.sum(F.least("n", F.lit(per_user))).alias("counted"))


def rolling_meter(df: DataFrame, user: str, at: str, hours: int, limit: int) -> DataFrame:
    """Adds ``used``, ``allowed``: rows of the user in the last ``hours`` hours, this one included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(user).orderBy(micros).rangeBetween(-hours * 3_600_000_000 + 1, 0)
    return df.withColumn("used", F.count(F.lit(1)).over(w)).withColumn("allowed", F.col("used") <= limit)
