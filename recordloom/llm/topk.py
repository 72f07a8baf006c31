"""Exact top-k by integer inner product: a three-phase uniform threshold search.

The dimensions are cut into slices; each slice of a block of vectors is one score list.

1. Every list gives its k best partial scores per query; the vectors so seen get their
   whole scores, and the k-th best of these over all blocks is a cutoff no answer falls
   below.
2. The cutoff comes back to every block. A whole score of at least ``cutoff`` has a partial
   score of at least ``cutoff / slices`` in some list, so each list collects the entries at
   or above that uniform threshold, and no others can matter.
3. The collected entries' scores are resolved exactly over all slices, and the best k
   of each block go to the final ranking.

Queries meet vectors block by block (both sides dealt by hashed block numbers), so rows
grow with queries times blocks, never with queries times vectors. Equal vectors are one
class that carries its k + 1 smallest ids, which is all that any ranking can use, so a
vector shared by a third of the table costs one row.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do rows without an id; vectors of different lengths are compared over their
common components; repeated rows (same id, same vector) count once; ties go to the smaller
id; components so large that ``scale`` times them is no long take the nearest long, and so
do scores; an empty table gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.storage import stored

SCALE = 1024
SLICES = 2
QUERY_BLOCK = 1024
VECTOR_BLOCK = 4096
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, q): whole components floor(scale * x) of the rows that take part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & fine)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: _floored(v.cast("double") * scale)).alias("q"))
        .distinct()
    )


def _floored(x: Column) -> Column:
    return F.when(x >= 2.0**63, F.lit(_MOST)).when(x < -(2.0**63), F.lit(-_MOST - 1)).otherwise(F.floor(x))


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pa.compute.list_value_length(column).to_numpy()


def _matrix(column: pa.ChunkedArray, dims: int, kind) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    length = _lengths(column)
    out = np.zeros((len(length), dims), kind)
    values = pa.compute.list_flatten(column).to_numpy()
    out[np.arange(dims)[None, :] < length[:, None]] = values if kind != object else [int(v) for v in values]
    return out


def _long(score) -> int:
    return max(-_MOST - 1, min(_MOST, int(score)))


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.dtype:
    """float64 while every sum stays an exact integer in it, else Python integers."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    return np.dtype(np.float64) if most < 2**53 else np.dtype(object)


def _partials(table: pa.Table, slices: int):
    asked = table.filter(table.column("asks"))
    held = table.filter(pa.compute.invert(table.column("asks")))
    if not len(asked) or not len(held):
        return None
    dims = max(int(_lengths(part.column("q")).max()) for part in (asked, held))
    a, b = _matrix(asked.column("q"), dims, np.float64), _matrix(held.column("q"), dims, np.float64)
    if _exact(a, b) == object:
        a, b = _matrix(asked.column("q"), dims, object), _matrix(held.column("q"), dims, object)
    cuts = np.linspace(0, dims, slices + 1).astype(int)
    lists = [a[:, lo:hi] @ b[:, lo:hi].T for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]
    return asked, asked.column("class_id").to_numpy(), held.column("class_id").to_numpy(), lists


def _seen_scores(table: pa.Table, k: int, slices: int) -> pa.Table:
    """Phase 1: whole scores of the vectors among the k best of any list."""
    query, score = [], []
    if (found := _partials(table, slices)) is not None:
        _, asks, holds, lists = found
        seen = np.zeros((len(asks), len(holds)), bool)
        for part in lists:
            kk = min(k, len(holds))
            best = np.argpartition(-part, kk - 1, axis=1)[:, :kk] if kk < len(holds) else np.tile(np.arange(len(holds)), (len(asks), 1))
            np.put_along_axis(seen, best, True, axis=1)
        for i in range(len(asks)):
            at = np.flatnonzero(seen[i])
            whole = sorted((_long(s) for s in sum(p[i, at] for p in lists)), reverse=True)[:k]
            query += [int(asks[i])] * len(whole)
            score += whole
    return pa.table({"query_class": pa.array(query, pa.int64()), "score": pa.array(score, pa.int64())})


def _resolved(table: pa.Table, k: int, slices: int) -> pa.Table:
    """Phases 2 and 3: entries at or above the uniform threshold, their exact scores, the k best."""
    query, held, score = [], [], []
    if (found := _partials(table, slices)) is not None:
        asked, asks, holds, lists = found
        for i, cutoff in enumerate(asked.column("cutoff").to_pylist()):
            if cutoff is None:
                at = np.arange(len(holds))
            else:
                enough = np.zeros(len(holds), bool)
                for part in lists:
                    enough |= part[i] * len(lists) >= cutoff
                at = np.flatnonzero(enough)
            whole = sum(p[i, at] for p in lists)
            if cutoff is not None:
                ok = np.asarray(whole >= cutoff, bool)
                at, whole = at[ok], whole[ok]
            order = sorted(range(len(at)), key=lambda j: (-_long(whole[j]), int(holds[at[j]])))[:k] if len(at) else []
            query += [int(asks[i])] * len(order)
            held += [int(holds[at[j]]) for j in order]
            score += [_long(whole[j]) for j in order]
    return pa.table({"query_class": pa.array(query, pa.int64()), "class_id": pa.array(held, pa.int64()), "score": pa.array(score, pa.int64())})


def _per_block(step, k, slices):
    def run(table):
        return step(table, k, slices)

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 10, slices: int = SLICES, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all rows but its own.

    ``is_query`` is a Column over ``vec_id`` that states the query set.
    """
    more = k + 1
    rows = stored(quantised(vectors, id_col, vector_col, scale), "vectors")
    first = Window.partitionBy("q").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= more)
    classes = stored(
        few.groupBy("q").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes"
    )
    askers = stored(rows.where(is_query).join(classes.select("q", "class_id"), "q").select("vec_id", "class_id"), "askers")
    asking = askers.select("class_id").distinct()
    n_held, n_asked = classes.count(), asking.count()
    held_blocks, asked_blocks = max(1, math.ceil(n_held / VECTOR_BLOCK)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    of = lambda salt, n: F.pmod(F.xxhash64("class_id", F.lit(salt)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    query_rows = classes.join(asking, "class_id", "left_semi")
    held = classes.select(of(1, held_blocks).alias("hb"), each(asked_blocks).alias("ab"), "class_id", "q", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("cutoff"))
    asks = query_rows.select(of(2, asked_blocks).alias("ab"), each(held_blocks).alias("hb"), "class_id", "q", F.lit(True).alias("asks"))

    blocks = held.unionByName(asks.withColumn("cutoff", F.lit(None).cast("long")))
    seen = blocks.groupBy("hb", "ab").applyInArrow(_per_block(_seen_scores, more, slices), "query_class long, score long")
    down = Window.partitionBy("query_class").orderBy(F.desc("score"))
    cutoffs = (
        seen.withColumn("nth", F.row_number().over(down)).where(F.col("nth") <= more)
        .groupBy("query_class").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).where(F.col("n") == more)
        .select(F.col("query_class").alias("class_id"), "cutoff")
    )
    cutoffs = stored(cutoffs, "cutoffs")
    with_cutoff = asks.join(cutoffs, "class_id", "left").select("hb", "ab", "class_id", "q", "asks", "cutoff")
    final = (
        held.unionByName(with_cutoff).groupBy("hb", "ab")
        .applyInArrow(_per_block(_resolved, more, slices), "query_class long, class_id long, score long")
    )
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    final = final.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= more).drop("nth")
    listed = final.join(classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= more).drop("nth")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        askers.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class")).join(listed, "query_class")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The contract's lists over all of ``embeddings``."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
