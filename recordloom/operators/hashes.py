"""Near 64-bit hashes by a Hamming index, and choices that skip near images."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.choice import first_come
from recordloom.storage import stored

BANDS, WIDTH = 4, 16
#: Two uploads of one picture differ by so many bits at most.
NEAR_BITS = 8


def _bands(hash_: Column, most: int) -> Column:
    """Keys of which two hashes within ``most`` bits share one: each band, and it with some bits flipped.

    Of four bands one has a quarter of the differing bits at most; flipping half of those on
    either side, rounded up, makes the two sides meet.
    """
    flips = -(-(most // BANDS) // 2)
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(WIDTH), n)]
    variants = F.array(*[F.lit(m) for m in masks])

    def keys(i: int) -> Column:
        band = F.conv(F.substring(hash_, 1 + 4 * i, 4), 16, 10).cast("int")
        return F.transform(variants, lambda m: F.lit(i << WIDTH) + band.bitwiseXOR(m))

    return F.flatten(F.array(*map(keys, range(BANDS))))


def near_pairs(hashes: DataFrame, most: int = NEAR_BITS, group: str = "group") -> DataFrame:
    """(group, ha, hb, bits) of distinct hashes of one group, ``ha < hb``, at most ``most`` bits apart.

    ``hashes`` has (group, h), h as 16 hex digits. Exact; a hash that many rows have is one
    row here, so copies of one image cost nothing.
    """
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")  # noqa: E731 - read once a hash, not once a pair
    distinct = hashes.where(F.col("h").isNotNull()).select(group, "h").distinct().select(group, "h", half(1).alias("x"), half(9).alias("y"))
    keyed = distinct.select(group, "h", "x", "y", F.explode(_bands(F.col("h"), most)).alias("_key"))
    a, b = (keyed.select(group, "_key", F.col("h").alias(f"h{e}"), F.col("x").alias(f"x{e}"), F.col("y").alias(f"y{e}")) for e in "ab")
    bits = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")))
    # the planner sizes keys like hashes and would send them to every task: each side is dealt by key
    met = a.join(b.hint("merge"), [group, "_key"]).where(F.col("ha") < F.col("hb")).select(group, "ha", "hb", bits.alias("bits"))
    return met.where(F.col("bits") <= most).distinct()


#: Rows of a group that one task compares with as many others, and rows at a time.
BLOCK, STRIP = 8192, 256


def all_near_pairs(hashes: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(a, b, bits) of items a < b of one group whose hashes are at most ``most`` bits apart.

    ``hashes`` has (group, item, h), items unique, h as 16 hex digits; a null group or hash has
    no pairs. For bits that many pairs are within, where no index saves comparing them all:
    a task compares one pair of blocks, and what travels is rows times a group's blocks.
    """
    rows = hashes.where(F.col("group").isNotNull() & F.col("h").isNotNull()).select("group", F.col("item").cast("long").alias("item"), "h")
    blocks = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    own = rows.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("item"), "blocks"))
    dealt = own.select("group", "own", "item", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    placed = dealt.select("group", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "item", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        item = table.column("item").to_numpy()
        h = np.array([int(x, 16) for x in table.column("h").to_pylist()], np.uint64)
        left, right = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        inside = bool(len(left)) and table.column("p")[0] == table.column("q")[0]
        for at in range(0, len(left), STRIP):
            x = left[at : at + STRIP]
            bits = np.bitwise_count(h[x][:, None] ^ h[right][None, :])
            i, j = np.nonzero(bits <= most)
            a, b, n = item[x[i]], item[right[j]], bits[i, j].astype(np.int32)
            if inside:  # both sides are the block: each pair comes twice, and each row meets itself
                a, b, n = a[a < b], b[a < b], n[a < b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n)], ["a", "b", "bits"])

    return placed.groupBy("group", "p", "q").applyInArrow(run, "a long, b long, bits int")


def distinct_images(images: DataFrame, limit: int, most: int = NEAR_BITS) -> DataFrame:
    """(group, item, place): the images of each group to show, at most ``limit``.

    ``images`` has (group, item, rank, url, h, publisher); in ascending rank an image is
    skipped if its address, or a hash within ``most`` bits of its own, is that of one chosen
    before. Of the others one per publisher leads, then the rest. An image without a hash is
    told by its address alone; ties of rank go to the smaller item.
    """
    rows = stored(images.select("group", "item", F.struct("rank", "item").alias("rank"), "url", "h", "publisher"), "images")
    pairs = near_pairs(rows, most)
    ends = pairs.select("group", F.explode(F.array("ha", "hb")).alias("h"), F.concat_ws("~", "ha", "hb").alias("cell"))
    claims = [
        rows.where(F.col("url").isNotNull()).select("group", "item", "rank", F.concat(F.lit("u:"), "url").alias("cell")),
        rows.where(F.col("h").isNotNull()).select("group", "item", "rank", F.concat(F.lit("h:"), "h").alias("cell")),
        rows.join(ends, ["group", "h"]).select("group", "item", "rank", "cell"),
    ]
    every = claims[0].unionByName(claims[1]).unionByName(claims[2]).withColumn("cell", F.struct("group", "cell")).withColumn("item", F.struct("group", "item"))
    taken = first_come(every, "item", "cell", "rank").where("taken").select("item.group", "item.item")
    bare = rows.where(F.col("url").isNull() & F.col("h").isNull()).select("group", "item")
    shown = rows.join(taken.unionByName(bare), ["group", "item"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("group", "publisher").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("lead"), "rank"))
    return shown.withColumn("lead", nth == 1).withColumn("place", place).where(F.col("place") <= limit).select("group", "item", "place")
