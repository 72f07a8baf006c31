"""Columns that pass through an operator, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Carried:
    """``df`` is the table with all columns but ``own`` under names of this class; ``back`` gives theirs back."""

    def __init__(self, table: DataFrame, *own: str):
        self.names = table.columns
        self.inner = [c if c in own else f"carried_{i}" for i, c in enumerate(self.names)]
        self.df = table.toDF(*self.inner)

    def others(self) -> list[str]:
        return [c for c in self.inner if c.startswith("carried_")]

    def back(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for c, n in zip(self.inner, self.names, strict=True)], *more)
