"""All pairs of sparse rows of a group that are alike enough, counted block against block.

For terms that very many rows share, where an index meets most pairs anyway. A group's rows
are dealt into hashed blocks and a task compares one pair of blocks, so what travels is rows
times a group's blocks, never a pair, and what a task holds is two blocks. There, frequent
terms are one matrix product and the others go by their lists of rows, so each pair's
score is whole and no row is looked up again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.storage import stored

#: Rows of a block, scores that a task holds at a time, and list entries that it adds at a time.
BLOCK, CELLS, ENTRIES = 32_768, 4_000_000, 4_000_000
#: Terms of more than this share of a block's rows go by matrix product, so many at most.
FREQUENT, MOST = 1 / 16, 1024

_SLACK = 1e-9


def _entries(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of ``counts[0]``, then those of the next."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class _Side:
    """The rows ``at`` of a block's flat (code, x) lists, in this order."""

    def __init__(self, at, starts, counts, code, x):
        self.at, self.n = at, counts[at]
        flat = _entries(starts[at], self.n)
        self.row, self.code, self.x = np.repeat(np.arange(len(at)), self.n), code[flat], None if x is None else x[flat]
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def dense(self, slot: np.ndarray, k: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, k), np.float32 if self.x is None else np.float64)
        part = slice(self.first[lo], self.first[hi])
        held = slot[self.code[part]] >= 0
        out[self.row[part][held] - lo, slot[self.code[part][held]]] = 1 if self.x is None else self.x[part][held]
        return out


def _scores(left: _Side, right: _Side, codes: int, inside: bool, floor: float | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(at, lo, scores) of strips of ``left`` from row ``at`` on against the rows of ``right`` from ``lo`` on.

    With a ``floor`` rows are sets in order of size, and those too small or large are left out.
    """
    df = np.bincount(right.code, minlength=codes)
    frequent = np.flatnonzero(df > FREQUENT * len(right.at))
    frequent = frequent[np.argsort(-df[frequent], kind="stable")][:MOST]
    slot = np.full(codes, -1)
    slot[frequent] = np.arange(len(frequent))
    whole = right.dense(slot, len(frequent), 0, len(right.at))
    rare = np.flatnonzero(slot[right.code] < 0)
    width = len(right.at)
    key = right.code[rare].astype(np.int64) * width + right.row[rare]
    order = np.argsort(key, kind="stable")
    key, lists = key[order], right.row[rare][order]
    weights = None if right.x is None else right.x[rare][order]
    strip = max(1, CELLS // max(1, width))
    for at in range(0, len(left.at), strip):
        end = min(at + strip, len(left.at))
        lo, hi = (at, width) if inside else (0, width)
        if floor is not None:
            lo = max(lo, int(np.searchsorted(right.n, left.n[at] * floor - _SLACK)))
            hi = min(hi, int(np.searchsorted(right.n, left.n[end - 1] / floor + _SLACK, "right")))
        if lo >= hi:
            continue
        scores = (left.dense(slot, len(frequent), at, end) @ whole[lo:hi].T).ravel()
        part = slice(left.first[at], left.first[end])
        ask = np.flatnonzero(slot[left.code[part]] < 0) + left.first[at]
        of = left.code[ask].astype(np.int64) * width
        first = np.searchsorted(key, of + lo)
        counts = np.searchsorted(key, of + hi) - first
        ask, first, counts = ask[counts > 0], first[counts > 0], counts[counts > 0]
        cuts = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum() + ENTRIES, ENTRIES)) if len(counts) else []
        for i, j in zip(cuts, [*cuts[1:], len(counts)], strict=False):
            if i == j:
                continue
            flat = _entries(first[i:j], counts[i:j])
            cell = np.repeat((left.row[ask[i:j]] - at) * (hi - lo) - lo, counts[i:j]) + lists[flat]
            scores += np.bincount(cell, None if weights is None else np.repeat(left.x[ask[i:j]], counts[i:j]) * weights[flat], len(scores))
        yield at, lo, scores.reshape(end - at, hi - lo)


def alike(rows: DataFrame, floor: float, weighted: bool, block: int = BLOCK) -> DataFrame:
    """(group, a, b, score, na, nb): pairs a < b of a group that are at least ``floor`` alike; exact.

    ``rows`` has (group, id, terms), and ``weighted`` also xs, the terms' weights; terms are distinct in
    a row and a (group, id) is there once. The score is the sum of products of weights, or
    the number of common terms where their Jaccard similarity reaches the floor.
    """
    keep = ["group", "id", "terms", *(["xs"] if weighted else [])]
    # stored: of measured size, it is sent to the rows instead of dealing them by group first
    blocks = stored(rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "blocks")
    cells = blocks.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    own = rows.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = own.select(*keep, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select(*keep, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * int(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, terms = (table.column(c).combine_chunks() for c in ("id", "terms"))
        counts = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, held = np.cumsum(counts) - counts, terms.flatten().dictionary_encode()
        code, x = held.indices.to_numpy(), table.column("xs").combine_chunks().flatten().to_numpy() if weighted else None
        # sets go in order of size, so that those near in size lie together
        flags = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        left, right = (_Side(at[np.argsort(counts[at], kind="stable")], starts, counts, code, x) for at in flags)
        inside, group = table.column("p")[0] == table.column("q")[0], table.column("group")[0]
        del table, terms
        for at, lo, score in _scores(left, right, len(held.dictionary), inside, None if weighted else floor):
            if weighted:
                ok = score >= floor
            else:
                ok = score >= floor / (1 + floor) * (left.n[at : at + len(score), None] + right.n[None, lo : lo + score.shape[1]]) - _SLACK
            i, j = np.nonzero(ok)
            if inside:
                i, j = i[i + at < j + lo], j[i + at < j + lo]
            a, b = i + at, j + lo
            n = [pa.array(s.n[e].astype(np.int32)) for s, e in ((left, a), (right, b))]
            yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * len(i), group.type), ids.take(pa.array(left.at[a])), ids.take(pa.array(right.at[b])), pa.array(score[i, j].astype(np.float64)), *n], ["group", "x", "y", "score", "nx", "ny"])

    out = placed.repartition(tasks, "group", "p", "q").groupBy("group", "p", "q").applyInArrow(run, f"group {kinds['group']}, x {kinds['id']}, y {kinds['id']}, score double, nx int, ny int")
    swap = F.col("x") > F.col("y")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return out.select("group", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score", either("nx", "ny").alias("na"), either("ny", "nx").alias("nb"))
