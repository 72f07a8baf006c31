"""File sources and sinks: feeds, JSON lines, fixtures, CSV exports, master data, published runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def export_fixture(df: DataFrame, path: str) -> None:
    """A slice as gzipped JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def load_fixture(spark: SparkSession, path: str, schema, at: str, newest: str) -> DataFrame:
    """A fixture with its times moved so that the newest row is at ``newest``."""
    df = spark.read.schema(schema).json(path)
    top = df.agg(F.max(at).alias("_top"))
    moved = F.col(at) + (F.lit(newest).cast("timestamp") - F.col("_top"))
    return df.join(F.broadcast(top)).withColumn(at, moved).drop("_top")


def export_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """One CSV file with a header and a fixed column order; for reports of a few rows."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """Changes replace target rows of the same key; of several changes the newest counts."""
    rows = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    value = F.struct(*[c for c in target.columns if c not in keys])
    best = rows.groupBy(*keys).agg(F.max_by(value, F.struct("_new", newest)).alias("_v"))
    return best.select(*keys, "_v.*").select(*target.columns)


class Runs:
    """Immutable runs below a folder; a manifest names the current one.

    ``publish`` writes a run apart, refuses an empty one, and moves the manifest only if it
    still names the run the caller started from, so two writers cannot both win.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.base}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def current(self) -> tuple[int, str | None]:
        """(version, run): 0 and None before the first run."""
        versions = self._manifests()
        if not versions:
            return 0, None
        text = self.spark.read.text(f"{self.base}/manifest/{versions[-1]}").first()[0]
        return versions[-1], json.loads(text)["run"]

    def publish(self, df: DataFrame, expected: int) -> str | None:
        """The new run's name, or None if another writer was first; an empty run raises."""
        run = uuid.uuid4().hex
        df.write.parquet(f"{self.base}/run={run}")
        if not self.spark.read.parquet(f"{self.base}/run={run}").take(1):
            self._fs.delete(self._path(f"{self.base}/run={run}"), True)
            raise ValueError("an empty run is never published")
        target = self._path(f"{self.base}/manifest/{expected + 1}")
        self._fs.mkdirs(self._path(f"{self.base}/manifest"))
        try:
            out = self._fs.create(target, False)  # fails if the version exists: the compare-and-set
        except Exception:  # noqa: BLE001 - any failure to create means another writer won
            return None
        out.write(bytearray(json.dumps({"run": run}).encode()))
        out.close()
        return run

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/run={self.current()[1]}")

    def prune(self, keep: int = 8) -> int:
        """Delete runs older than the newest ``keep`` manifests; the number deleted."""
        versions = self._manifests()
        gone = 0
        for v in versions[:-keep]:
            run = json.loads(self.spark.read.text(f"{self.base}/manifest/{v}").first()[0])["run"]
            gone += self._fs.delete(self._path(f"{self.base}/run={run}"), True)
            self._fs.delete(self._path(f"{self.base}/manifest/{v}"), True)
        return gone
