"""Structured Streaming: staged topics on files, dead letters, idempotent sinks, debounce, meters.

Every query keeps its offsets and state in a checkpoint folder, so a lost executor or a
restarted driver continues where it stopped; sinks are keyed by batch, so a batch that
runs again replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from recordloom.storage import scratch_root

#: Membership counts at which a record is analysed again.
TIERS = (2, 3, 5, 8, 13, 21, 34)
DEBOUNCE_S = 90
GIVE_UP = 3


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """A stream of the files at ``path``; ``per_trigger`` bounds what one batch takes in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run ``stream`` over all that is there now, then return what it wrote.

    Appended batches go to folders of their own; complete and update output replaces the
    last batch's.
    """
    spark = stream.sparkSession
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    out = f"{base}/out"

    def sink(batch: DataFrame, n: int) -> None:
        if each is not None:
            each(batch, n)
        path = f"{out}/batch={n}" if mode == "append" else f"{out}/batch=0"
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def routed(live_path: str, shadow_path: str, live: bool) -> Callable[[DataFrame, int], None]:
    """A batch sink for a stage on trial: its output goes to the shadow path until it is live.

    Batches keep their numbers in either place, so a batch that runs again replaces itself.
    """

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{live_path if live else shadow_path}/batch={n}")

    return sink


def every(stream: DataFrame, interval: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a periodic job: a batch each ``interval`` (as in "10 minutes") of what came meanwhile; returns the running query."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(sink).start()


def trimmed(topic: DataFrame, batch: str, keep: int) -> DataFrame:
    """The newest whole batches of a topic that hold ``keep`` rows or more: an approximate trim, which never cuts a batch."""
    sizes = topic.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    newer = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc(batch)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return topic.join(sizes.withColumn("_newer", newer).where(F.col("_newer") < keep).select(batch), batch, "left_semi")


def reclaimed(claims: DataFrame, item: str, worker: str, at: str, done: str, idle_seconds: int, most_deliveries: int = GIVE_UP) -> DataFrame:
    """item, worker, last_seen, deliveries, fate: items that were claimed, are not done and gave no sign of life for ``idle_seconds``.

    ``claims`` is a log of claims and heartbeats; ``done`` is true on a row that ends the item.
    Time is the log's own newest row. ``fate`` is ``reclaim``, or ``dead`` once an item went to
    ``most_deliveries`` workers.
    """
    last = claims.groupBy(item).agg(
        F.max_by(worker, F.struct(at, worker)).alias("worker"), F.max(at).alias("last_seen"), F.countDistinct(worker).alias("deliveries"), F.max(F.col(done).cast("int")).alias("_done")
    )
    now = claims.agg(F.max(at)).scalar()
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) >= idle_seconds * 1_000_000
    fate = F.when(F.col("deliveries") >= most_deliveries, "dead").otherwise("reclaim")
    return last.where((F.col("_done") == 0) & quiet).select(item, "worker", "last_seen", "deliveries", fate.alias("fate"))


def staged(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead): payloads that parse, and those that don't, kept with what was wrong."""
    parsed = raw.withColumn("p", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("p").isNull() | F.col("p._bad").isNotNull()
    return parsed.where(~bad).select("p.*").drop("_bad"), parsed.where(bad).select("value", F.lit("unparsable").alias("reason"))


def given_up(failures: DataFrame, key: str, limit: int = GIVE_UP) -> DataFrame:
    """Keys that failed ``limit`` times; callers drop them with a left_anti join."""
    return failures.groupBy(key).agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= limit)


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """At-least-once input made exactly-once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def upsert_counts(stream: DataFrame, keys: list) -> DataFrame:
    """Counters by key, to be drained in complete or update mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, *keys) -> DataFrame:
    """Counts per event-time window, closed once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def debounce(stream: DataFrame, key: str, at: str, seconds: int = DEBOUNCE_S) -> DataFrame:
    """(key, due, n): a key is handed on ``seconds`` after its first row; rows until then wait with it.

    ``at`` is a timestamp with a watermark; a key whose time has passed by the watermark is
    handed on by a timer even if no more rows come.
    """

    def run(k, frames, state):
        due, n = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], pd.Timestamp(due, unit="us", tz="UTC"), n))
            state.remove()
        else:
            for t in sorted(x for f in frames for x in f[at].astype("int64").tolist()):
                t = t if t > 1e17 else t * 1000  # nanoseconds or microseconds since 1970
                t //= 1000
                if due is not None and t > due:
                    out.append((k[0], pd.Timestamp(due, unit="us", tz="UTC"), n))
                    due, n = None, 0
                due, n = (t + seconds * 1_000_000 if due is None else due), n + 1
            state.update((due, n))
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "due", "n"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, due timestamp, n long", "due long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def tiers_reached(stream: DataFrame, key: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(key, members): each tier of membership that a key reaches."""

    def run(k, frames, state):
        before = state.get[0] if state.exists else 0
        now = before + sum(len(f) for f in frames)
        state.update((now,))
        yield pd.DataFrame([(k[0], t) for t in tiers if before < t <= now], columns=[key, "members"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} long, members long", "n long", "append", GroupStateTimeout.NoTimeout)


def match_or_create(stream: DataFrame, key: str, identity: str, at: str) -> DataFrame:
    """(key, founder, members): each row joins its key's record or founds it.

    One writer handles one batch at a time, so no lock is needed. Each batch writes a new
    version of the table that its number names; a batch that runs again starts from the
    version before it.
    """
    spark = stream.sparkSession
    base = f"{scratch_root(spark)}/records-{uuid.uuid4().hex[:12]}"
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, founder long, founded timestamp, members long"

    def handle(batch: DataFrame, n: int) -> None:
        new = batch.groupBy(key).agg(F.min_by(F.col(identity), F.struct(at, identity)).alias("founder"), F.min(at).alias("founded"), F.count(F.lit(1)).alias("members"))
        old = spark.read.schema(schema).parquet(f"{base}/version={n - 1}") if n else spark.createDataFrame([], schema)
        rows = old.unionByName(new.select(key, F.col("founder").cast("long").alias("founder"), "founded", "members"))
        merged = rows.groupBy(key).agg(F.min_by("founder", F.struct("founded", "founder")).alias("founder"), F.min("founded").alias("founded"), F.sum("members").alias("members"))
        merged.write.mode("overwrite").parquet(f"{base}/version={n}")
        last[0] = n

    last = [-1]
    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/version={last[0]}").drop("founded")
