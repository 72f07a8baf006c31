"""Shared scratch storage for results that later stages read more than once.

``stored`` writes a DataFrame as Parquet below the cluster's checkpoint folder and
reads it back. Lineage ends there, so a lost executor costs a re-read and never a
recomputation, and the reread table has exact statistics for the planner.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests, notebooks) gets a folder of its
    machine; on a cluster the setting must name a folder that all nodes share.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes of the cluster share")
            base = "file://" + tempfile.mkdtemp(prefix="recordloom-")
        _ROOTS[app] = (spark, f"{base.rstrip('/')}/recordloom-{uuid.uuid4().hex}")
        atexit.register(clear_scratch, spark)
    return _ROOTS[app][1]


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to scratch storage and return the table read back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this session stored; safe to call more than once."""
    entry = _ROOTS.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc else None
    if entry is None:
        return
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(entry[1])
    try:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may already be going down
        pass
