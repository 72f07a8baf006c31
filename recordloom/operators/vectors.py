"""Dense-vector operators: cosine, centroids and exact blocked nearest neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Rows that pass by at once, in multiples of the block.
CHUNK = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, centroid: the mean vector of each key, averaged per component (combined map-side)."""
    parts = df.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c"))
    return ordered.select(key, F.col("_c._m").alias("centroid"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows of doubles; null components are not numbers."""
    flat = [c for c in column.chunks if len(c)]
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in flat]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(df: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", floor: float | None = None, asked: Column | None = None, block: int = BLOCK, digits: int = 12) -> DataFrame:
    """vec_id, nbr_id, rnk, sim: the k most similar other vectors by cosine of ``digits`` digits, ties to the smaller id.

    Exact: asking rows are dealt into hashed blocks, the others stream past each block in
    chunks and a row keeps its k best of those gone by, which leaves fewer and fewer to
    look at. Only small tables deal the others into parts too, so that all cores have work,
    and a window picks among the parts' lists. Rows shuffled grow with rows times blocks,
    lists with rows. Vectors that hold null or no numbers take no part.
    """
    rows = _rows(df, id_col, vector)
    return _blocked(rows if asked is None else rows.where(asked), rows, k, floor, True, block, digits)


def nearest_to(df: DataFrame, targets: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", target_id: str = "id", target_vector: str = "centroid", block: int = BLOCK) -> DataFrame:
    """vec_id, nbr_id, rnk, sim: each row's k most similar targets, blocked like ``nearest``."""
    return _blocked(_rows(df, id_col, vector), _rows(targets, target_id, target_vector), k, None, False, block, 12)


def _rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x"))


def _blocks(n: int, block: int, widest: int) -> int:
    """Blocks of ``n`` rows: a dozen of ``block`` rows keep all cores at work, beyond that they grow to ``widest`` times as many."""
    return max(1, min(math.ceil(n / block), max(12, math.ceil(n / (widest * block)))))


def _blocked(asks: DataFrame, held: DataFrame, k: int, floor: float | None, apart: bool, block: int, digits: int) -> DataFrame:
    """The k best of ``held`` for each row of ``asks``; ``apart`` leaves out a row's own id."""
    n_a, n_b = _dealt(asks.count(), held.count(), block)
    if asks.schema["x"].dataType != held.schema["x"].dataType:
        asks, held = (x.withColumn("x", F.col("x").cast("array<double>")) for x in (asks, held))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = asks.select(own(n_a).alias("ab"), every(n_b).alias("bb"), "id", "x", F.lit(True).alias("asks"))
    b = held.select(own(n_b).alias("bb"), every(n_a).alias("ab"), "id", "x", F.lit(False).alias("asks")).select("ab", "bb", "id", "x", "asks")

    def run(batches):
        left, chunk, waiting, best = [], [], 0, None

        def looked():
            nonlocal best
            best = best or _Best(*_sound(left), k, floor, apart, digits)
            best.see(*_sound(chunk))

        for batch in batches:
            asks_ = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            n = int(asks_.sum())  # asking rows come first
            if n:
                left.append(batch.slice(0, n))
            if n < len(batch):
                chunk.append(batch.slice(n))
                waiting += len(batch) - n
            if waiting >= CHUNK * block:
                looked()
                chunk, waiting = [], 0
        if left and chunk:
            looked()
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in best.lists()], names=["vec_id", "nbr_id", "sim"])

    task = (F.col("ab") * n_b + F.col("bb")).cast("int")
    dealt = a.unionByName(b).repartitionById(n_a * n_b, task).sortWithinPartitions(F.desc("asks"))
    found = dealt.select("id", "x", "asks").mapInArrow(run, "vec_id long, nbr_id long, sim double")
    best = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "nbr_id")
    return found.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= k).select("vec_id", "nbr_id", "rnk", "sim")


def _dealt(asks: int, held: int, block: int) -> tuple[int, int]:
    """Blocks of the asking rows and parts of the others: one part as soon as the blocks keep all cores at work."""
    n_a = _blocks(asks, block, 4)
    return n_a, min(_blocks(held, block, 8), math.ceil(24 / n_a))


def _sound(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that hold numbers alone."""
    table = pa.Table.from_batches(batches)
    x = _matrix(table.column("x"))
    sound = np.isfinite(x).all(axis=1)
    return table.column("id").to_numpy()[sound], _unit(x[sound])


class _Best:
    """The k best of what went by for each of some rows; found ones wait until they are as many as those kept."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: float | None, apart: bool, digits: int):
        self.ids, self.x, self.how = ids, x, (k, floor, apart, digits)
        self.names, self.row = np.unique(ids, return_inverse=True)
        self.least = np.full(len(self.names), -np.inf)
        self.kept, self.waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def see(self, ids: np.ndarray, y: np.ndarray) -> None:
        for found in _tops(self.ids, self.x, ids, y, *self.how, self.least[self.row]):
            self.kept.append(found)
            self.waiting += len(found[0])
        if self.waiting >= self.how[0] * len(self.names):
            self.lists()

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.how[0]
        ids, others, sims = map(np.concatenate, zip(*self.kept, strict=True))
        order = np.lexsort((others, -sims, ids))
        ids, others, sims = ids[order], others[order], sims[order]
        nth = np.arange(len(ids)) - np.searchsorted(ids, ids)
        full = nth == k - 1
        self.least[np.searchsorted(self.names, ids[full])] = sims[full]
        self.kept, self.waiting = [(ids[nth < k], others[nth < k], sims[nth < k])], 0
        return self.kept[0]


def _tops(left: np.ndarray, x: np.ndarray, right: np.ndarray, y: np.ndarray, k: int, floor: float | None, apart: bool, digits: int, bound: np.ndarray | None = None):
    """(ids of ``left``, of ``right``, similarities): each row's k first by rounded similarity down, id up.

    Products in single precision leave out what can't be among the first: the greatest of
    each of some groups of columns bound the k-th from below, and the rest is compared
    with that bound less the error of rounding. What remains is computed in double. A row of
    ``left`` may have its own ``bound``, under which nothing is wanted.
    """
    if not len(left) or not len(right):
        return
    k_, groups = k + apart, 4 * (k + apart)
    slack = 4e-7 * (x.shape[1] + 8) + 2.0 * 10.0**-digits
    y_ = np.ascontiguousarray(y.T.astype(np.float32))
    step = max(1, (1 << 22) // len(right))
    for at in range(0, len(left), step):
        rough = x[at : at + step].astype(np.float32) @ y_
        least = np.full(len(rough), -np.inf if floor is None else floor - slack, np.float32)
        deep = len(right) // groups
        if bound is not None:
            least = np.maximum(least, (bound[at : at + step] - slack).astype(np.float32))
        if deep > 1 and (bound is None or not np.isfinite(bound[at : at + step]).all()):
            tops = rough[:, : deep * groups].reshape(len(rough), deep, groups).max(axis=1)
            least = np.maximum(least, np.partition(tops, groups - k_, axis=1)[:, groups - k_] - np.float32(slack))
        i, j = np.divmod(np.flatnonzero((rough >= least[:, None]).ravel()), len(right))
        sims = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[at + i[n : n + 65536]], y[j[n : n + 65536]]) for n in range(0, len(i), 65536)])
        sims = np.round(sims, digits) + 0.0
        keep = np.ones(len(i), bool) if floor is None else sims >= floor
        if apart:
            keep &= right[j] != left[at + i]
        i, j, sims = i[keep], j[keep], sims[keep]
        order = np.lexsort((right[j], -sims, i))
        i, j, sims = i[order], j[order], sims[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield left[at + i[first]], right[j[first]], sims[first]


def similarity_counts(df: DataFrame, label: str, digits: int = 3, id_col: str = "vec_id", vector: str = "embedding", dims: int | None = None, block: int = BLOCK) -> DataFrame:
    """sim, same, n: all unordered pairs counted by rounded cosine and by whether their labels agree.

    Block pairs are multiplied where they are dealt and only their histograms travel, so
    the rows shuffled are vectors times blocks. ``dims`` compares leading components alone.
    """
    x = F.col(vector) if dims is None else F.slice(vector, 1, dims)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    blocks = max(1, math.ceil(rows.count() / block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    placed = rows.select(own.alias("own"), "id", "label", "x").select("own", "id", "label", "x", every.alias("other"))
    dealt = placed.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "label", "x")

    def run(table):
        own_, q = table.column("own").to_numpy(), table.column("q").to_numpy()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        unit = _unit(_matrix(table.column("x")))
        left = np.flatnonzero(own_ == table.column("p").to_numpy())
        right = np.flatnonzero(own_ == q)
        counts: dict[tuple[float, bool], int] = {}
        for at in range(0, len(left), 512):
            rows_ = left[at : at + 512]
            sims = np.round(unit[rows_] @ unit[right].T, digits) + 0.0
            keep = ids[rows_][:, None] < ids[right][None, :] if table.column("p")[0] == table.column("q")[0] else np.ones(sims.shape, bool)
            same = labels[rows_][:, None] == labels[right][None, :]
            for flag in (True, False):
                values, n = np.unique(sims[keep & (same == flag)], return_counts=True)
                for v, c in zip(values.tolist(), n.tolist(), strict=True):
                    counts[v, flag] = counts.get((v, flag), 0) + c
        items = sorted(counts.items())
        return pa.table({"sim": pa.array([k[0] for k, _ in items], pa.float64()), "same": pa.array([k[1] for k, _ in items], pa.bool_()), "n": pa.array([c for _, c in items], pa.int64())})

    parts = dealt.groupBy("p", "q").applyInArrow(run, "sim double, same boolean, n long")
    return parts.groupBy("sim", "same").agg(F.sum("n").alias("n"))


def mutual(neighbours: DataFrame) -> DataFrame:
    """a < b, sim: pairs in which each is among the other's neighbours."""
    back = neighbours.select(F.col("vec_id").alias("nbr_id"), F.col("nbr_id").alias("vec_id"))
    both = neighbours.join(back, ["vec_id", "nbr_id"])
    return both.where(F.col("vec_id") < F.col("nbr_id")).select(F.col("vec_id").alias("a"), F.col("nbr_id").alias("b"), "sim")
