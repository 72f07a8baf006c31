"""Operators on records and their reports: corroboration, clocks, ranking, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking rule.
RECENCY_HOURS = 168
MOST_CORROBORATION = 4
FIRST_LANGUAGE, OTHER_LANGUAGE = 0.3, 0.15
DECAY_PER_DAY = 0.03
#: Fixed values of the breaking rule.
BREAKING_OUTLETS, BREAKING_LANGUAGES, BREAKING_MINUTES = 6, 2, 120


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours with fractions, exact to the microsecond."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def corroboration(reports: DataFrame) -> DataFrame:
    """event_id, reports, outlets, sources: publishers count, not feeds or reports."""
    return reports.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("reports"), F.countDistinct("publisher").alias("outlets"), F.countDistinct("source_id").alias("sources")
    )


def served(reports: DataFrame, raw_sources: DataFrame) -> DataFrame:
    """Records with a report from a source that is not a raw-record feed."""
    return reports.join(raw_sources, "source_id", "left_anti").select("event_id").distinct()


def lens_score(age_hours: Column, outlets: Column, recency: float, corroboration: float, language_bonus: Column | None = None) -> Column:
    """Linear decay over seven days plus a bounded bonus per further outlet."""
    fresh = F.greatest(F.lit(0.0), 1.0 - F.greatest(age_hours, F.lit(0.0)) / RECENCY_HOURS)
    score = fresh * recency + F.least(outlets - 1, F.lit(MOST_CORROBORATION)) * corroboration
    return score if language_bonus is None else score + language_bonus


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rnk") -> DataFrame:
    """The first k rows of each group; Spark prunes to k per task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def first_published(reports: DataFrame, records: DataFrame) -> DataFrame:
    """event_id, first_published: the earliest report inside [first_seen - 7 days, first_seen + 1 hour], else first_seen."""
    seen = F.col("first_seen")
    sane = F.col("published_at").between(seen - F.expr("INTERVAL 7 DAYS"), seen + F.expr("INTERVAL 1 HOUR"))
    joined = records.select("event_id", "first_seen").join(reports.select("event_id", "published_at"), "event_id", "left")
    return joined.groupBy("event_id").agg(F.coalesce(F.min(F.when(sane, F.col("published_at"))), F.min("first_seen")).alias("first_published"))


def velocity(reports: DataFrame, as_of: Column, recent_hours: int) -> DataFrame:
    """event_id, recent, total, newest: distinct publishers lately and overall."""
    recent = F.col("published_at") > as_of - F.make_interval(hours=F.lit(recent_hours))
    return reports.where(F.col("published_at") <= as_of).groupBy("event_id").agg(
        F.countDistinct(F.when(recent, F.col("publisher"))).alias("recent"), F.countDistinct("publisher").alias("total"), F.max("published_at").alias("newest")
    )


def breaking(reports: DataFrame, outlets: int = BREAKING_OUTLETS, languages: int = BREAKING_LANGUAGES, window_minutes: int = BREAKING_MINUTES) -> DataFrame:
    """Records that enough outlets in enough languages reported soon after the first report."""
    first = reports.groupBy("event_id").agg(F.min("published_at").alias("first_at"))
    soon = reports.join(first, "event_id").where(F.col("published_at") <= F.col("first_at") + F.make_interval(mins=F.lit(window_minutes)))
    counted = soon.groupBy("event_id").agg(F.countDistinct("publisher").alias("outlets"), F.countDistinct("lang").alias("langs"))
    return counted.where((F.col("outlets") >= outlets) & (F.col("langs") >= languages))


def majority(df: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """key, value, n: the most frequent value of each key; ties go to the one seen first."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_first"))
    return top_per_group(counted, [key], [F.desc("n"), F.asc("_first"), F.asc(value)], 1).select(key, value, "n")


def half_vote(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) pairs that at least half of the key's rows chose."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    chosen = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return chosen.join(total, key).where(F.col("n") * 2 >= F.col("total"))


def interleave(df: DataFrame, key: list[str], lane: str, first_lane: str, order: list[Column]) -> DataFrame:
    """Round-robin over lanes: each lane's first row before any second; ``first_lane`` leads, then larger lanes."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*key, lane))
    nth = F.row_number().over(Window.partitionBy(*key, lane).orderBy(*order))
    placed = df.withColumn("_size", size).withColumn("_nth", nth)
    turn = Window.partitionBy(*key).orderBy("_nth", F.desc(F.col(lane) == first_lane), F.desc("_size"), lane)
    return placed.withColumn("place", F.row_number().over(turn)).drop("_size", "_nth")


def islands(df: DataFrame, key: str, seq: str) -> DataFrame:
    """key, start, end, n: runs of consecutive ``seq`` of one key (gaps and islands)."""
    run = F.col(seq) - F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return df.withColumn("_run", run).groupBy(key, "_run").agg(F.min(seq).alias("start_id"), F.max(seq).alias("end_id"), F.count(F.lit(1)).alias("n")).drop("_run")
