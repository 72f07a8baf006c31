"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits share a variant within r/2 flips of both,
so each fingerprint is matched on all its variants within half the radius. Variants are
dealt by their leading bits: a fingerprint travels once to each prefix that any of its
variants can have (1 + b + b(b-1)/2 rows instead of 2081 at r = 4), and the task that
owns a prefix generates the variants below it, deduplicates and verifies the colliding
pairs. The prefix grows with the number of distinct fingerprints; a prefix that still
holds over ``MOST_BELOW`` of them is dealt again by further bits before the shuffle, and
a task splits what is above its memory on further bits yet.

Exact copies collapse to one fingerprint before anything is matched. All fingerprints in
one collision are within r of each other, so a star of verified links per collision joins
the same components as all pairs would.

Defined cases: a null or empty text has no words and fingerprint zero, which links like
any other; a text of fewer words than a shingle is one shingle; repeated rows share a
component; a null doc_id never becomes a component's id unless no member has another; an
empty table gives an empty result; a very long text is hashed whole, in one piece; only
``doc_id`` and ``text`` are read, so further columns of any name do not clash.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.columns import Carried
from recordloom.llm.sketches import shingle_hashes
from recordloom.llm.workers import lean, release
from recordloom.operators.components import connected_components
from recordloom.storage import stored

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Word fingerprints from which near copies are found.
VIEWS = 6
#: Bands of least shingle hashes: of pairs that are 0.8 alike, all but (1 - 0.8 ** ROWS) ** BANDS, 1 in 20,000, share one.
BANDS = 25
ROWS = 5
#: Variants that one task sorts at once, 8 bytes each.
VARIANTS_AT_ONCE = 2_000_000
#: Variants below one prefix, in portions of the above.
VARIANTS_PER_PREFIX = 36_000_000
#: Fingerprints below one prefix, before it is dealt again by ``MORE_BITS`` further bits.
MOST_BELOW = 2_000_000
MORE_BITS = 8


def simhash64(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer: a bit is set if over half of all shingle hashes set it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        value = xxhash.xxh64_intdigest(joined, seed)
        return value - (1 << 64) if value >> 63 else value
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)],
        dtype="<u8",
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; map-only."""

    def run(batches):
        for batch in batches:
            fps = [simhash64(t.as_py(), words, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, fp long")


def _ball(bits: int, flips: int) -> np.ndarray:
    """All masks over ``bits`` bits with exactly ``flips`` set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), flips)], dtype=np.uint64)


def _collide(low, budget, owner, bits, emit, at_once):
    """Owners of equal variants: ``low`` are the open bits, ``budget`` the flips left."""
    size = sum(int((budget >= f).sum()) * math.comb(bits, f) for f in range(int(budget.max(initial=0)) + 1))
    if size > at_once and bits > 1:
        top = (low >> np.uint64(bits - 1)) & np.uint64(1)
        rest = low & np.uint64((1 << (bits - 1)) - 1)
        for side in (0, 1):
            left = budget - (top != side)
            keep = left >= 0
            if keep.sum() > 1:
                _collide(rest[keep], left[keep], owner[keep], bits - 1, emit, at_once)
        return
    values, owners = [], []
    for flips in range(int(budget.max(initial=0)) + 1):
        can = budget >= flips
        masks = _ball(bits, flips)
        values.append((low[can][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(owner[can], len(masks)))
    value, own = np.concatenate(values), np.concatenate(owners)
    mixed = (value * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFF000000)
    packed = mixed | own.astype(np.uint64)
    packed.sort()
    same = (packed[1:] >> np.uint64(24)) == (packed[:-1] >> np.uint64(24))
    if not same.any():
        return
    run = np.cumsum(np.concatenate(([True], ~same))) - 1
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    emit((packed[shared] & np.uint64(0xFFFFFF)).astype(np.int64), run[shared])


def _owners(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(open bits, flips left, place) of the fingerprints that have variants below the prefix."""
    bits = 64 - prefix_bits
    away = np.bitwise_count((fps >> np.uint64(bits)) ^ np.uint64(prefix)).astype(np.int64)
    budget = radius // 2 - away
    keep = budget >= 0
    return fps[keep] & np.uint64((1 << bits) - 1), budget[keep], np.flatnonzero(keep)


def _links(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links found below one prefix."""
    fps = np.unique(fps.astype(np.int64)).view(np.uint64)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    def emit(who, run):
        first = np.concatenate(([True], run[1:] != run[:-1]))
        lead, mate, run = who[np.flatnonzero(first)][np.cumsum(first) - 1][~first], who[~first], run[~first]
        good = np.bitwise_count(fps[lead] ^ fps[mate]) <= radius
        for pair in np.unique((lead[good] << 24) | mate[good]).tolist():
            join(pair >> 24, pair & 0xFFFFFF)
        for r in np.unique(run[~good]):  # two variants met in 40 bits of their hash: look at each pair of the run
            members = sorted({int(lead[run == r][0]), *mate[run == r].tolist()})
            for a, b in combinations(members, 2):
                if int(np.bitwise_count(fps[a] ^ fps[b])) <= radius:
                    join(a, b)

    _collide(*_owners(fps, prefix, prefix_bits, radius), 64 - prefix_bits, emit, at_once)
    ends = [(x, find(x)) for x in parent]
    ends = [(x, r) for x, r in ends if x != r]
    u = np.array([x for x, _ in ends], np.int64)
    v = np.array([r for _, r in ends], np.int64)
    signed = fps.view(np.int64)
    return signed[u], signed[v]


def _pairs(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that collide below one prefix: all of a small collision, a star of a large one.

    The star's centre is the member that collides most often, as the text that others were
    copied from does.
    """
    fps = np.unique(fps.astype(np.int64)).view(np.uint64)
    found: list[np.ndarray] = []

    def emit(who, run):
        first = np.concatenate(([True], run[1:] != run[:-1]))
        own = np.cumsum(first) - 1
        size = np.bincount(own)[own]
        often = np.bincount(who, minlength=len(fps))[who]
        order = np.lexsort((who, -often, own))
        centre = who[order][np.flatnonzero(first)][own]
        pairs = [np.stack([centre, who])]
        for step in (1, 2):
            if len(who) > step:
                near = (own[step:] == own[:-step]) & (size[step:] <= 4)
                pairs.append(np.stack([who[:-step][near], who[step:][near]]))
        a, b = np.concatenate(pairs, axis=1)
        keep = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
        found.append(np.unique((np.minimum(a, b)[keep] << 24) | np.maximum(a, b)[keep]))

    _collide(*_owners(fps, prefix, prefix_bits, radius), 64 - prefix_bits, emit, at_once)
    codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    signed = fps.view(np.int64)
    return signed[codes >> 24], signed[codes & 0xFFFFFF]


def _dealt(distinct: DataFrame, bits: int, half: int, carried: list[str], most: int, n: int) -> DataFrame:
    """(view, fp, bits, prefix): every fingerprint at each prefix that its variants can have."""
    masks = lambda wide: F.transform(F.array(*[F.lit(int(m)) for f in range(half + 1) for m in _ball(wide, f)]), lambda m: m.cast("long"))
    prefix = F.shiftrightunsigned("fp", 64 - bits)
    sent = distinct.select("view", "fp", *carried, F.lit(bits).alias("bits"), F.explode(F.transform(masks(bits), lambda m: prefix.bitwiseXOR(m))).alias("prefix"))
    while n > most and bits + MORE_BITS < 60:
        hot = stored(sent.groupBy("view", "bits", "prefix").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n"), "hot")
        if not hot.take(1):
            break
        deep = bits + MORE_BITS
        left = half - F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("prefix")))
        own = F.shiftrightunsigned("fp", 64 - deep).bitwiseAND(F.lit((1 << MORE_BITS) - 1))
        near = F.filter(masks(MORE_BITS), lambda m: F.bit_count(m) <= left)
        split = sent.join(hot, ["view", "bits", "prefix"]).withColumn("_m", F.explode(near))
        split = split.select("view", "fp", *carried, F.lit(deep).alias("bits"), F.shiftleft("prefix", MORE_BITS).bitwiseOR(own.bitwiseXOR(F.col("_m"))).alias("prefix"))
        sent = stored(sent.join(hot, ["view", "bits", "prefix"], "left_anti").select(split.columns).unionByName(split), "dealt")
        bits = deep
    return sent


def fingerprint_links(
    distinct: DataFrame, radius: int = RADIUS, count: int | None = None, at_once: int = VARIANTS_AT_ONCE, forest: bool = True, views: int = 1, most: int = MOST_BELOW
) -> DataFrame:
    """(view, u, v): links among the fingerprints (column ``fp``, distinct in each ``view``) within ``radius`` bits.

    ``radius`` must be even. With ``forest`` each task returns a spanning forest of the
    links it verified, which joins all that are linked; else the pairs of ``_pairs``, with
    the ``head`` of either fingerprint as uh and vh. The prefix is chosen for the mean size of
    ``views`` views.
    """
    if radius % 2:
        raise ValueError("radius must be even: each side takes half of it")
    half = radius // 2
    if "view" not in distinct.columns:
        distinct = distinct.withColumn("view", F.lit(0))
    n = distinct.count() if count is None else count
    variants = n / views * sum(math.comb(64, f) for f in range(half + 1))
    bits = max(4, math.ceil(math.log2(max(1, variants / VARIANTS_PER_PREFIX))))
    sent = _dealt(distinct, bits, half, [] if forest else ["head"], most, n)
    find = _links if forest else _pairs

    def run(key, table):
        fps = table.column("fp").to_numpy()
        u, v = find(fps, key[2].as_py(), key[1].as_py(), radius, at_once)
        out = {"view": pa.array([key[0].as_py()] * len(u), pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}
        if not forest:
            heads, order = table.column("head").to_numpy(), np.argsort(fps)
            out |= {name: pa.array(heads[order[np.searchsorted(fps, x, sorter=order)]], pa.int64()) for name, x in (("uh", u), ("vh", v))}
        release()
        return pa.table(out)

    return sent.groupBy("view", "bits", "prefix").applyInArrow(run, "view int, u long, v long" + ("" if forest else ", uh long, vh long"))


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of ``radius`` bits reach."""
    marks = stored(fingerprints(docs, words, seed), "simhash")
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    links = fingerprint_links(distinct.select("fp"), radius)
    roots = connected_components(links)
    reached = (
        distinct.join(roots, distinct.fp == roots.node, "left")
        .select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    )
    reached = stored(reached, "reached")
    least = reached.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = reached.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def word_prints(text: str | None, views: int) -> list[int]:
    """``views`` fingerprints of the text's distinct words, each under a hash of its own."""
    words = shingle_hashes(text or "", 1)
    out = []
    for k in range(views):
        mixed = (words ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        counts = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits((counts * 2 > len(words)).astype(np.uint8), bitorder="little").view("<i8")[0]))
    return out


def band_keys(text: str | None, words: int, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """A hash of the ``rows`` least values of each band, every value under a hash of its own; none without shingles."""
    shingles = shingle_hashes(text or "", words)
    if not len(shingles):
        return []
    own, mix = np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        mixed = (shingles[at : at + 512, None] ^ own) * mix
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * mix).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), n) - (1 << 63) for n, x in enumerate(least.astype("<u8").reshape(bands, rows))]


def _shingle_sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t.as_py() or "", words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _alike(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
                a, b = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= least * max(len(a), len(b)) else 0
                keep.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rare_pairs(sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """u < v: documents of different roots that share one of their rarest shingles.

    Two sets that are ``least`` alike share an element among the first
    ``n - ceil(least * n) + 1`` of either in any one order; here the rarest of ``sets`` come
    first, so what many documents have in common makes no pairs unless they have little else.
    """
    each = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    listed = each.join(df, "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("rare"))
    first = F.slice("rare", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
    keys = stored(listed.select("id", "n", F.explode(first).alias("r")).where(F.col("r.df") > 1).select(F.col("r.s").alias("s"), "id", "n").join(roots, "id"), "rare")
    a, b = (keys.select("s", F.col("id").alias(x), F.col("root").alias(f"{x}_root"), F.col("n").alias(f"{x}_n")) for x in "uv")
    near = F.least("u_n", "v_n") >= least * F.greatest("u_n", "v_n")
    return a.join(b, "s").where((F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root")) & near).select("u", "v").distinct()


def _texts(marks: DataFrame) -> DataFrame:
    """(id, first, mark, print, prints, bands): one row per distinct text; ``first`` is its least doc_id.

    ``id`` is ``first``, but for texts that share it with another text, of which all but one
    get a hash instead.
    """
    texts = stored(marks.groupBy("mark", "print").agg(F.min("doc_id").alias("first"), F.first("prints").alias("prints"), F.first("bands").alias("bands")), "texts")
    clash = texts.groupBy("first").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("mark", "print")).alias("_least")).where(F.col("_n") > 1).drop("_n")
    if not clash.take(1):
        return texts.withColumn("id", F.col("first"))
    own = F.col("_least").isNull() | (F.struct("mark", "print") == F.col("_least"))
    return stored(texts.join(clash, "first", "left").withColumn("id", F.when(own, F.col("first")).otherwise(F.xxhash64("first", "mark", "print"))).drop("_least"), "texts")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, views: int = VIEWS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, mark, component_id, lead): documents joined by a Jaccard similarity of word shingles.

    A 64-bit fingerprint of five-word shingles moves by some ten bits at a similarity of 0.8,
    far beyond the radius. Its candidates therefore come from ``views`` fingerprints of the
    distinct words, which scattered edits move by little, and from bands of least shingle
    hashes, which depend on the similarity alone and so also meet where a passage was added,
    cut or replaced; the pairs found are verified on the whole sets of shingles. Equal texts
    are one.

    Texts that share a fingerprint or band meet its centre, the one that shares most with
    others, as the text that others were copied from does. Groups that the verified links
    still leave in several parts are then joined exactly, by an index of their rarest
    shingles in which only texts of different parts meet.

    ``mark`` is the hash of the row's text, ``lead`` is true for the row that stays: of the
    component's smallest doc_id, the text with the smallest mark.
    """

    def prints(batches):
        for batch in batches:
            found = [word_prints(t.as_py(), views) for t in batch.column("text")]
            bands = [band_keys(t.as_py(), words) for t in batch.column("text")]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, bands)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *lists], names=["doc_id", "mark", "prints", "bands"])

    base = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    marks = stored(base.mapInArrow(lean(prints), "doc_id long, mark long, prints array<long>, bands array<long>"), "prints")
    marks = marks.withColumn("print", F.get("prints", F.lit(0)))
    texts = _texts(marks)
    seen = texts.select("id", F.posexplode(F.concat("prints", "bands")).alias("view", "fp"))
    spots = stored(seen.groupBy("view", "fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "spots")
    crowded = stored(seen.join(spots.where(F.col("n") > 1).select("view", "fp", "n"), ["view", "fp"]), "crowded")
    often = crowded.groupBy("id").agg(F.sum("n").alias("often"))
    centres = crowded.join(often, "id").groupBy("view", "fp").agg(F.min_by("id", F.struct(-F.col("often"), F.col("id"))).alias("head"))
    centres = stored(centres, "centres")
    heads = spots.where((F.col("n") == 1) & (F.col("view") < views)).select("view", "fp", F.col("id").alias("head")).unionByName(centres.where(F.col("view") < views))
    pairs = stored(fingerprint_links(heads, radius, forest=False, views=views).distinct(), "pairs")
    members = stored(crowded.join(centres, ["view", "fp"]).where(F.col("id") != F.col("head")).select("view", "fp", "id", "head"), "members")
    each = [
        pairs.select(F.col("uh").alias("a"), F.col("vh").alias("b")), members.select(F.col("id").alias("a"), F.col("head").alias("b")),
        pairs.join(members.select("view", F.col("fp").alias("u"), "id"), ["view", "u"]).select(F.col("id").alias("a"), F.col("vh").alias("b")),
        pairs.join(members.select("view", F.col("fp").alias("v"), "id"), ["view", "v"]).select(F.col("uh").alias("a"), F.col("id").alias("b")),
    ]
    every = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).where(F.col("a") != F.col("b"))
    every = stored(every.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "candidates")

    def sets_of(ids):
        asked = texts.select("id", F.col("first").alias("doc_id"), "mark").join(ids, "id", "left_semi")
        rows = base.join(asked, ["doc_id", "mark"]).select("id", "text").dropDuplicates(["id"])
        return stored(rows.mapInArrow(lean(_shingle_sets(words)), "id long, shingles array<long>"), "sets")

    def verified(pairs, sets):
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("xs")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("ys")), "v")
        return stored(both.mapInArrow(lean(_alike(similarity)), "u long, v long"), "links")

    links = verified(every, sets_of(every.select(F.col("u").alias("id")).union(every.select("v")).distinct()))
    roots = connected_components(links)
    # groups that the links leave in parts
    rooted = stored(crowded.join(roots.withColumnRenamed("node", "id"), "id", "left").select("view", "fp", "id", F.coalesce("root", "id").alias("root")), "rooted")
    parted = rooted.groupBy("view", "fp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high"))
    apart = stored(rooted.join(parted.select("view", "fp"), ["view", "fp"], "left_semi").select("id", "root").distinct(), "apart")
    if apart.take(1):
        sets = sets_of(apart.select("id"))
        rest = stored(_rare_pairs(sets, apart, similarity).join(every, ["u", "v"], "left_anti"), "rest")
        more = verified(rest, sets)
        if more.take(1):
            roots = connected_components(links.unionByName(more))
    named = stored(texts.join(roots, texts["id"] == roots["node"], "left").select("mark", "print", "first", F.coalesce("root", "id").alias("root")), "named")
    leads = named.groupBy("root").agg(F.min(F.struct("first", "mark")).alias("lead"))
    named = named.join(leads, "root").select("mark", "print", "lead")
    rows = marks.join(named, ["mark", "print"])
    return rows.select("doc_id", "mark", F.col("lead.first").alias("component_id"), ((F.col("doc_id") == F.col("lead.first")) & (F.col("mark") == F.col("lead.mark"))).alias("lead"))


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, views: int = VIEWS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of smallest doc_id.

    Repeated rows of one doc_id and text are one document, of which one row stays; rows of
    one doc_id and texts that are not alike are documents of their own. A row without a
    doc_id can't be named in a group and stays.
    """
    carried = Carried(docs, "doc_id", "text")
    docs = carried.df
    groups = near_copies(docs.select("doc_id", "text"), words, similarity, views, radius)
    keep = groups.where("lead").select(F.col("doc_id").alias("id"), F.col("mark").alias("m")).distinct()
    own = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = own.join(keep, (F.col("doc_id") == F.col("id")) & (F.col("mark") == F.col("m")), "left_semi")
    return carried.back(kept.dropDuplicates(["doc_id", "mark"]).drop("mark").unionByName(docs.where(F.col("doc_id").isNull())))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all of ``documents``."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
