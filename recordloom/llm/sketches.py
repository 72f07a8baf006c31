"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch retains every distinct shingle hash below a fixed fraction of the hash range and
nothing else, so its size follows the document's and two sketches of very unequal
documents still answer how much of one is contained in the other. The union of two
sketches is the sketch of both documents together, so sketches merge. Hashes have 32
bits; with n retained hashes a likeness j is off by about sqrt(j (1 - j) / n).

A sketch of one text also carries how many distinct shingles it has and the exclusive or of
their 64-bit hashes. Two texts are alike 1 only if both agree, and no two are alike more
than their numbers of shingles allow, so texts too short to retain anything are not taken
for equal. Of a union neither is known, as shared shingles would count twice; merged
sketches go without.

Documents meet their successor in one pass: rows are dealt by ranges of doc_id, sorted in
their range, and the first row of each range is also sent to the end of the range
before. An id that fills several ranges, and the rows without one, are parted further by
the hash of their text. The ranges' number follows the bytes of text up to ``MOST_RANGES``;
only their bounds reach the driver, and a task streams its ranges row by row.

Defined cases: a null text is empty; a text without words has an empty sketch, as may one
of very few words; an empty sketch is alike 1 to that of the same shingles (or, merged, to
another empty one) and 0 to any other;
fewer words than a shingle make one shingle; a very long text is sketched whole, in one
piece; rows of equal doc_id follow one another by the hash of their text, rows without
doc_id come last, by the same; a table of one row has itself as successor; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.workers import lean

WORDS = 5
FRACTION = 1 / 2
RANGE_BYTES = 32_000_000
MOST_RANGES = 16_384
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
        _powers[base] = have
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), dtype=np.uint64)))
    word = _mixed((sums[end] - sums[start]) * _power(_BASE_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))
    n = max(1, len(word) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(words, len(word))):
        out = out * np.uint64(0x100000001B3) + _mixed(word[j : j + n] + np.uint64(j))
    return np.unique(_mixed(out))


class Sketch(np.ndarray):
    """Retained hashes, sorted; ``whole`` is the (number, exclusive or) of all distinct shingle hashes, if known."""

    whole: tuple[int, int] | None = None


def sketch(text: str, words: int = WORDS, fraction: float = FRACTION) -> Sketch:
    """The retained hashes, with the number and exclusive or of all."""
    every = shingle_hashes(text, words)
    hashes = np.unique((every >> np.uint64(32)).astype(np.uint32))
    kept = hashes[: np.searchsorted(hashes, fraction * 2**32)].view(Sketch)
    kept.whole = len(every), int(np.bitwise_xor.reduce(every)) if len(every) else 0
    return kept


def _most_alike(a: Sketch, b: Sketch) -> float:
    """No two texts with these whole counts are more alike."""
    if a.whole is None or b.whole is None or a.whole == b.whole:
        return 1.0
    low, high = sorted((a.whole[0], b.whole[0]))
    return low / high if low < high else (low - 1) / (low + 1)


def compare(a: Sketch, b: Sketch) -> tuple[float, float | None, float | None]:
    """(likeness, share of a in b, share of b in a); a share of nothing is None."""
    if not len(a) or not len(b):
        return float(len(a) == len(b) and _most_alike(a, b) == 1.0), None, None
    both = len(np.intersect1d(a, b, assume_unique=True))
    return min(both / (len(a) + len(b) - both), _most_alike(a, b)), both / len(a), both / len(b)


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b).view(Sketch)


def to_text(hashes: Sketch) -> str:
    """Eight hex digits a hash; for one text also a dash, the number of shingles and 16 digits of their exclusive or."""
    text = hashes.astype(">u4").tobytes().hex()
    return text if hashes.whole is None else f"{text}-{hashes.whole[0]:x}{hashes.whole[1]:016x}"


def from_text(fingerprint: str) -> Sketch:
    hashes, _, whole = fingerprint.partition("-")
    found = np.frombuffer(bytes.fromhex(hashes), ">u4").astype(np.uint32).view(Sketch)
    found.whole = (int(whole[:-16], 16), int(whole[-16:], 16)) if whole else None
    return found


def _range_of(bounds: list[float], repeats: list[int], none_ranges: int) -> Column:
    """The range of a row by doc_id, then by the hash of its text where one id fills several ranges."""
    by_mark = F.col("mark").cast("double") / F.lit(2.0**64) + 0.5
    part = lambda n: F.least(F.floor(by_mark * n), n - 1)
    if not bounds:
        return F.when(F.col("doc_id").isNull(), part(F.lit(none_ranges))).otherwise(F.lit(-1)).cast("long")
    listed = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    edge, times = listed(bounds, "double"), listed(repeats, "int")
    # the place of an id among the bounds, by halving
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def halve(lo, step):
        at = lo + step
        return F.when((at <= len(bounds)) & (F.col("id_") >= F.get(edge, at - 1)), at).otherwise(lo)

    place = F.aggregate(steps, F.lit(0), halve)
    n = F.coalesce(F.get(times, place - 1), F.lit(0))
    sub = F.when((n > 1) & (F.col("id_") == F.get(edge, place - 1)), part(n)).otherwise(n)
    wide = MOST_RANGES + 1
    return F.when(F.col("doc_id").isNull(), F.lit((len(bounds) + 1) * wide) + part(F.lit(none_ranges))).otherwise(place * wide + sub).cast("long")


def _ranges(spark: SparkSession, docs: DataFrame, n: int, none_ranges: int) -> DataFrame:
    """(doc_id, text, mark, range, late): each row in its range, the head of a range also at the end of the one before."""
    cuts = Counter(docs.approxQuantile("id_", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else [])
    bounds = sorted(cuts)
    # beyond 2**53 a double stands for several ids, which must stay together
    rows = docs.withColumn("range", _range_of(bounds, [cuts[b] if abs(b) < 2.0**53 else 1 for b in bounds], none_ranges))
    heads = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("head")).orderBy("range").collect()
    before = [(r["head"]["doc_id"], r["head"]["mark"], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(before, "head long, head_mark long, to long"))  # one row for each range
    also = rows.join(small, rows.doc_id.eqNullSafe(small["head"]) & (rows.mark == small["head_mark"])).dropDuplicates(["to"])
    also = also.select("doc_id", "text", "mark", F.col("to").alias("range"), F.lit(True).alias("late"))
    return rows.select("doc_id", "text", "mark", "range", F.lit(False).alias("late")).unionByName(also)


def with_successor(docs: DataFrame, each, schema: str, names: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``each(doc_id, text, state, next_text, next_state) -> tuple`` for every row and the row after it.

    ``each.state(text)`` is made once per row. After the last row comes the first.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("mark", F.xxhash64("text")).withColumn("id_", F.col("doc_id").cast("double"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    n = min(MOST_RANGES, max(4 * tasks, size["bytes"] // range_bytes))
    none_ranges = max(1, n * size["none"] // max(1, size["n"]))
    dealt = _ranges(spark, base, n, none_ranges).repartition(max(tasks, n // 4), "range").sortWithinPartitions("range", "late", "doc_id", "mark")
    types = pa.schema([pa.field(n, t) for n, t in zip(names, each.types, strict=True)])

    def run(batches):
        last, last_range, done, out, size = None, None, False, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.column("range")[i].as_py()
                if r != last_range:
                    last, last_range, done = None, r, False
                if done:
                    continue
                late = batch.column("late")[i].as_py()
                text = batch.column("text")[i].as_py()
                now = (batch.column("doc_id")[i].as_py(), text, each.state(text))
                if last is not None:
                    out.append(each(*last, *now[1:]))
                    size += len(text)
                last, done = now, late
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return dealt.mapInArrow(lean(run), schema)


class _Edited:
    """The contract's row for a document and its successor."""

    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64())

    def __init__(self, words: int, fraction: float):
        self.words, self.fraction = words, fraction

    def state(self, text: str) -> Sketch:
        return sketch(text, self.words, self.fraction)

    def __call__(self, doc_id, text, own, next_text, next_own):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + next_text[:quarter]
        changed = self.state(edited)
        near, inside, _ = compare(own, changed)
        near_next, inside_next, _ = compare(own, next_own)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, to_text(own), to_text(changed), near, near_next, inside, inside_next


def fingerprints(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """(doc_id, fingerprint) for every row; map-only."""

    def run(batches):
        for batch in batches:
            marks = [to_text(sketch(t.as_py() or "", words, fraction)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, fingerprint string")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all of ``documents``; the shares contained are extra columns."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"
    return with_successor(spark.read.parquet(f"{sf_dir}/documents.parquet"), _Edited(WORDS, FRACTION), schema, names)
