"""Nearest neighbours by Euclidean distance: a block matrix join of int8 tiles.

Queries and vectors are dealt into hashed blocks, and every block of queries meets every
stripe of vectors. A task holds one block of queries and streams the stripe past it, tile
by tile:

1. both sides are coded as int8 with a scale per vector; how far the code lies from its
   vector is kept, so the distance of two codes, which is one matrix product per tile,
   gives by the triangle inequality a lower and an upper bound of the true distance;
2. pairs whose lower bound is above the k-th smallest upper bound of the tile, or above
   the k-th distance found so far, cannot be answers;
3. the surviving pairs are recomputed in double precision from the vectors themselves and
   pushed on one bounded heap per query, which later tiles are held against.

The lists of the stripes meet by query and are merged by heaps again. Products of int8
codes are summed in floating point that holds every such sum exactly. The result is exact:
bounds only decide which pairs need not be looked at. Rows grow with queries times stripes
and vectors times query blocks, never with queries times vectors. Equal vectors are one
class that carries its k + 1 smallest ids, which is all that any list can use.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows without an id; of vectors of different lengths the shorter is
filled up with zeros; an id stands for one vector, of repeated rows the least; ties go to
the smaller id; distances beyond a double are infinite and tie; an empty table gives an
empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from recordloom.llm.workers import lean
from recordloom.storage import stored

K = 10
#: Queries that a task holds, and those of them that one tile is wide.
QUERY_BLOCK = 8192
QUERY_TILE = 512
VECTOR_TILE = 2048
#: Vectors of a stripe, and the least that are worth a stripe of their own.
STRIPE = 8192
SMALL_STRIPE = 2048
#: List entries that one merging group takes.
MERGED = 200_000
_PAIRS = 1 << 15


def comparable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, one of each id."""
    x = F.col(vector_col)
    if not isinstance(vectors.schema[vector_col].dataType.elementType, (FloatType, DoubleType)):
        x = x.cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, dims: int = 0) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros."""
    length = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(length), max(dims, int(length.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


class Coded:
    """int8 codes of vectors: ``x`` lies within ``error`` of ``scale * codes``."""

    def __init__(self, x: np.ndarray):
        self.x = x
        with np.errstate(all="ignore"):
            self.scale = np.abs(x).max(axis=1, initial=0) / 127
            unit = np.where(self.scale > 0, self.scale, 1)[:, None]
            self.codes = np.clip(np.rint(x / unit), -127, 127).astype(np.int8)
            near = self.codes * unit
            self.size = np.sqrt((near * near).sum(axis=1))
            # what rounding adds to sizes and products stays far below this share of them
            self.error = np.sqrt(((x - near) ** 2).sum(axis=1)) + 1e-7 * self.size

    def __getitem__(self, rows: slice) -> Coded:
        part = object.__new__(Coded)
        for name in ("x", "scale", "codes", "size", "error"):
            setattr(part, name, getattr(self, name)[rows])
        return part


def bounds(a: Coded, b: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile; not a number where a double is too small."""
    whole = np.float32 if a.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (a.codes.astype(whole) @ b.codes.astype(whole).T).astype(np.float64)
    with np.errstate(all="ignore"):
        product *= -2 * a.scale[:, None] * b.scale[None, :]
        product += a.size[:, None] ** 2 + b.size[None, :] ** 2
        about = np.sqrt(np.maximum(product, 0))
        off = a.error[:, None] + b.error[None, :]
        return about - off, about + off


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed component by component."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for d in range(x.shape[1]):
            total += (x[:, d] - y[:, d]) ** 2
        return np.sqrt(total)


class Lists:
    """The ``most`` nearest of each query of a block, over all tiles added so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int):
        self.ids, self.coded, self.most = ids, Coded(x), most
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.cut = np.full(len(ids), np.inf)
        self.recomputed = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        held = Coded(x)
        for lo in range(0, len(self.ids), QUERY_TILE):
            here = slice(lo, lo + QUERY_TILE)
            lower, upper = bounds(self.coded[here], held)
            cut = self.cut[here]
            if len(ids) > self.most:
                cut = np.fmin(cut, np.partition(upper, self.most - 1, axis=1)[:, self.most - 1])
            # written so that a bound that is not a number survives
            query, vector = np.nonzero(~(lower > cut[:, None]))
            for at in range(0, len(query), _PAIRS):
                q, v = query[at : at + _PAIRS], vector[at : at + _PAIRS]
                self._push(lo + q, ids[v], distances(self.coded.x[lo + q], x[v]))

    def _push(self, rows: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        self.recomputed += len(rows)
        near = found <= self.cut[rows]
        for row, vec, far in zip(rows[near].tolist(), ids[near].tolist(), found[near].tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.most:
                heapq.heappush(heap, (-far, -vec))
            else:
                heapq.heappushpop(heap, (-far, -vec))
            if len(heap) == self.most:
                self.cut[row] = -heap[0][0]

    def rows(self) -> tuple[list[int], list[int], list[float]]:
        query = [q for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for _ in heap]
        return query, [-v for heap in self.heaps for _, v in heap], [-d for heap in self.heaps for d, _ in heap]


_LISTED = pa.schema([("query_class", pa.int64()), ("class_id", pa.int64()), ("score", pa.float64())])


def _listed(rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _LISTED, strict=True)], schema=_LISTED)


def _tiled(most: int, dims: int, tile: int):
    """Rows sorted by group, queries first: one block of queries in memory, the vectors tile by tile."""

    def run(batches):
        group, asked, lists, held = None, [], None, []

        def flush() -> None:
            nonlocal lists, held
            if lists is None and asked:
                ids = np.concatenate([i for i, _ in asked])
                lists = Lists(ids, np.concatenate([x for _, x in asked]), most)
                asked.clear()
            if lists is not None and held:
                lists.add(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
            held = []

        for batch in batches:
            keys = batch.column("g").to_numpy()
            ends = [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if keys[lo] != group:
                    flush()
                    if lists is not None:
                        yield _listed(lists.rows())
                    group, lists = keys[lo], None
                for at in range(lo, hi, tile):
                    part = batch.slice(at, min(tile, hi - at))
                    asks = part.column("asks").to_numpy(zero_copy_only=False)
                    ids, x = part.column("class_id").to_numpy(), _matrix(part.column("v"), dims)
                    if asks.any():
                        asked.append((ids[asks], x[asks]))
                    if not asks.all():
                        held.append((ids[~asks], x[~asks]))
                    if sum(len(i) for i, _ in held) >= tile:
                        flush()
        flush()
        if lists is not None:
            yield _listed(lists.rows())

    return run


def _merged(most: int):
    def run(table: pa.Table) -> pa.Table:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for query, vec, far in zip(*(table.column(n).to_pylist() for n in ("query_class", "class_id", "score")), strict=True):
            heap = heaps.setdefault(query, [])
            (heapq.heappush if len(heap) < most else heapq.heappushpop)(heap, (-far, -vec))
        rows = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
        return pa.Table.from_batches([_listed(tuple(zip(*rows, strict=True)) or ([], [], []))])

    return run


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest among all rows but its own.

    ``is_query`` is a Column over ``vec_id`` that states the query set.
    """
    most = k + 1
    spark = vectors.sparkSession
    rows = stored(comparable(vectors, id_col, vector_col), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    classes = stored(few.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    askers = stored(rows.where(is_query).join(classes.select("v", "class_id"), "v").select("vec_id", "class_id"), "askers")
    asking = askers.select("class_id").distinct()
    n_asked = asking.count()
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n_asked / QUERY_BLOCK))
    stripes = max(1, math.ceil(size["n"] / STRIPE), min(tasks, math.ceil(size["n"] / SMALL_STRIPE)))
    of = lambda salt, n: F.pmod(F.xxhash64("class_id", F.lit(salt)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    group = (F.col("block") * stripes + F.col("stripe")).alias("g")
    held = classes.select(each(blocks).alias("block"), of(1, stripes).alias("stripe"), "class_id", "v").select(group, "class_id", "v", F.lit(False).alias("asks"))
    asks = (
        classes.join(asking, "class_id", "left_semi")
        .select(of(2, blocks).alias("block"), each(stripes).alias("stripe"), "class_id", "v").select(group, "class_id", "v", F.lit(True).alias("asks"))
    )
    listed = (
        held.unionByName(asks).repartition(min(blocks * stripes, max(tasks, blocks * stripes // 16)), "g").sortWithinPartitions("g", F.desc("asks"))
        .mapInArrow(lean(_tiled(most, size["dims"], VECTOR_TILE)), "query_class long, class_id long, score double")
    )
    groups = max(tasks, math.ceil(n_asked * stripes * most / MERGED))
    merged = (
        listed.withColumn("m", F.pmod(F.xxhash64("query_class"), F.lit(groups))).groupBy("m")
        .applyInArrow(_merged(most), "query_class long, class_id long, score double")
    )
    named = merged.join(classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query_class").orderBy("score", "vec_id")
    named = named.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= most).drop("nth")
    mine = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        askers.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query_class")).join(named, "query_class")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The contract's lists over all of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         sqrt(list_reduce(list_transform(list_zip(a.v, b.v), lambda p: (coalesce(p[1], 0) - coalesce(p[2], 0)) * (coalesce(p[1], 0) - coalesce(p[2], 0))), lambda x, y: x + y)) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
