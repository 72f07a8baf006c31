"""Table functions and an aggregate for SQL: chunks of texts, sessions of ordered rows, a mean without its tails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from recordloom.functions.unicode import chunks

#: Share of a group's values that ``trimmed_mean`` leaves out at either end.
TAIL = 0.1


class TextChunks:
    """``text_chunks(text, size => 1200, overlap => 150)``: one row per chunk, for LATERAL joins."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text_chunks takes a string")
        for name, given in (("size", size), ("overlap", overlap)):
            if given is not None and (given.value is None or given.value < 0):
                raise ValueError(f"text_chunks takes a constant {name} of at least 0")
        return AnalyzeResult(StructType([StructField("chunk_index", IntegerType()), StructField("chunk", StringType())]))

    def eval(self, text, size=1200, overlap=150):
        yield from enumerate(chunks(text, size, overlap))


class Sessions:
    """``sessions(TABLE(t) PARTITION BY key ORDER BY time, gap_seconds)``: runs of rows no further apart than the gap.

    The table has a key and a time, whatever their names; the key's name and type pass
    through. Rows come in the order of the call, one key after another, so a task holds one
    open session. Rows without a time are in no session.
    """

    def __init__(self):
        self.key = self.start = self.last = None
        self.n = self.number = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, gap_seconds: AnalyzeArgument) -> AnalyzeResult:
        fields = table.dataType.fields if table.isTable else []
        if len(fields) != 2 or not isinstance(fields[1].dataType, (TimestampType, TimestampNTZType)):
            raise ValueError("sessions takes a table of a key and a time")
        if gap_seconds.value is None or gap_seconds.value < 0:
            raise ValueError("sessions takes a constant gap of at least 0 seconds")
        time = fields[1].dataType
        return AnalyzeResult(StructType([
            StructField(fields[0].name, fields[0].dataType), StructField("session", IntegerType()), StructField("started", time), StructField("ended", time), StructField("n", LongType()),
        ]))

    def _closed(self):
        self.number += 1
        return self.key, self.number, self.start, self.last, self.n

    def eval(self, row, gap_seconds):
        key, at = row[0], row[1]
        if at is None:
            return
        if self.n and (at - self.last).total_seconds() > gap_seconds:
            yield self._closed()
            self.n = 0
        self.key, self.start, self.last, self.n = key, at if not self.n else self.start, at, self.n + 1

    def terminate(self):
        if self.n:
            yield self._closed()


def trimmed_mean(values: pd.Series) -> float:
    """Mean of a group's values without the lowest and highest ``TAIL`` of them, counted down; null if none is left."""
    kept = values.dropna().sort_values()
    cut = int(len(kept) * TAIL)
    kept = kept.iloc[cut : len(kept) - cut]
    return float(kept.mean()) if len(kept) else None


#: ``trimmed_mean`` of a group's values in an array, without Python: for very many groups.
TRIMMED_MEAN_OF = f"""CREATE OR REPLACE TEMPORARY FUNCTION trimmed_mean_of(xs ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
  aggregate(array(array_sort(filter(xs, x -> x IS NOT NULL AND NOT isnan(x)))), CAST(NULL AS DOUBLE), (none, s) ->
    aggregate(slice(s, 1 + CAST(size(s) * {TAIL}D AS INT), size(s) - 2 * CAST(size(s) * {TAIL}D AS INT)), 0D, (sum, x) -> sum + x, sum -> CASE WHEN size(s) > 0 THEN sum / (size(s) - 2 * CAST(size(s) * {TAIL}D AS INT)) END))"""


def register(spark: SparkSession) -> None:
    """Make ``text_chunks``, ``sessions``, ``trimmed_mean`` and ``trimmed_mean_of`` callable from SQL."""
    spark.sql(TRIMMED_MEAN_OF)
    spark.udtf.register("text_chunks", F.udtf(TextChunks, useArrow=True))
    spark.udtf.register("sessions", F.udtf(Sessions, useArrow=True))
    spark.udf.register("trimmed_mean", F.pandas_udf(trimmed_mean, "double"))
