"""Many strings searched in many texts at once: what texts hold meets the strings in an equi-join.

A string of fewer than 16 characters has its length as class, and its hash is made of those of
its first and last characters; texts hash every place for each such length. A longer string's
class is the largest power of two it has characters for. Its anchor is the least hash of the
``gram`` characters at each place of its first ``class`` characters. Texts sample the same way:
of every run of that many characters they keep the place of the least hash. Wherever a string
occurs, the text's run there is the string's own beginning, so the text keeps the place of its
anchor too.

Places whose hash no string has are dropped where they are made, by a bitmap of the strings'
hashes of bounded size. The others travel with the characters around them that a string of
their class can have, near ones in one piece, and are checked there: texts are read once and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.storage import stored

#: By length class: characters of a gram.
GRAMS = {1: 1, 2: 2, 4: 4, 8: 8, 16: 8} | {1 << n: 16 for n in range(5, 31)}
#: Strings of fewer characters are hashed as a whole.
SAMPLED = 16
#: Bits of the bitmap of asked hashes for each of them, and at least and most altogether, as powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 18, 26
#: Characters after which a batch of found places is handed on.
BATCH_CHARS = 1 << 22
#: Characters of a piece, in multiples of the class.
PIECE = 8
_CLASS = 40503
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: str, sizes: Iterable[int]) -> dict[int, np.ndarray]:
    """By size, a power of two: the hash of so many characters from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    have, size, out = _mixed((codes + np.uint64(1)) * _FACTOR), 1, {}
    for wanted in sorted(set(sizes)):
        while size < wanted:
            have = _mixed(have[:-size] * _FACTOR + have[size:]) if len(have) > size else have[:0]
            size *= 2
        out[wanted] = have
    return out


def least_places(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each run of ``run`` hashes, where its least one is, the first of equals."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at, width = hashes, np.arange(len(hashes)), 1
    while 2 * width <= run:
        right = least[width:] < least[:-width]
        at = np.where(right, at[width:], at[:-width])
        least, width = hashes[at], 2 * width
    later = run - width
    return np.where(least[later : later + n] < least[:n], at[later : later + n], at[:n])


def anchors(text: str, classes: Iterable[int]) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """(class, places, hashes) of the sampled places of a text."""
    grams = gram_hashes(text, {GRAMS[c] for c in classes})
    for c in classes:
        hashes = grams[GRAMS[c]]
        places = np.unique(least_places(hashes, c - GRAMS[c] + 1))
        if len(places):
            yield c, places, hashes[places].view(np.int64)


def string_class(length: int) -> int:
    """The class of a string of so many characters."""
    return length if length < SAMPLED else 1 << min(length.bit_length() - 1, 30)


def whole_hashes(grams: dict[int, np.ndarray], length: int) -> np.ndarray:
    """The hash of ``length`` characters, fewer than ``SAMPLED``, from each place on."""
    part = 1 << (length.bit_length() - 1)
    have, later = grams[part], length - part
    return have if not later else _mixed(have[: max(0, len(have) - later)] * _FACTOR + have[later:])


def asked_bits(strings: DataFrame) -> np.ndarray:
    """A bitmap, as bytes, with the low bits of each ``hash`` set; of at most ``MOST_BITS``, whatever the strings."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * strings.count()).bit_length()))
    at = F.col("hash").bitwiseXOR(F.col("class").cast("long") * _CLASS).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    parts = strings.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    held = np.zeros((1 << bits) // 8, np.uint8)
    for bucket, bitmap in parts.collect():  # 2,048 at most
        found = np.frombuffer(bitmap, np.uint8)
        held[(bucket - 1) * len(found) : bucket * len(found)] = found
    return held


def _is_asked(hashes: np.ndarray, c: int, bits: np.ndarray) -> np.ndarray:
    at = (hashes ^ np.uint64(c * _CLASS)) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def found_pieces(text: str, classes: Iterable[int], bits: np.ndarray) -> Iterable[tuple[int, int, int, str, list[int]]]:
    """(class, hash, from, around, places) of the places whose hash may be asked, counted from where ``around`` begins.

    ``around`` is what strings of the class with their anchors there can have. Equal pieces
    are given once, where they are first.
    """
    grams = gram_hashes(text, {1 << (c.bit_length() - 1) for c in classes if c < SAMPLED})
    for c in (c for c in classes if c < SAMPLED):
        hashes, seen = whole_hashes(grams, c), set()
        for p in np.flatnonzero(_is_asked(hashes, c, bits)).tolist():
            if (around := text[p : p + c]) not in seen:
                seen.add(around)
                yield c, int(hashes[p].view(np.int64)), p, around, [0]
    for c, places, hashes in anchors(text, [c for c in classes if SAMPLED <= c <= len(text)]):
        asked = np.flatnonzero(_is_asked(hashes.view(np.uint64), c, bits))
        order = asked[np.argsort(hashes[asked], kind="stable")]
        same, pieces = None, []
        for p, h in zip(places[order].tolist(), hashes[order].tolist(), strict=True):
            if h == same and p < pieces[-1][1][-1] + 2 * c and p + 2 * c <= pieces[-1][1][0] + PIECE * c:
                pieces[-1][1].append(p)
            else:
                pieces.append((h, [p]))
            same = h
        seen = set()
        for h, ps in pieces:
            lo = max(0, ps[0] - c + GRAMS[c])
            key = (h, text[lo : ps[-1] + 2 * c], tuple(p - lo for p in ps))
            if key not in seen:
                seen.add(key)
                yield c, h, lo, key[1], list(key[2])


_PIECES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("class", pa.int32()), ("hash", pa.int64()), ("from", pa.int32()), ("around", pa.string()), ("places", pa.list_(pa.int32()))])


def _found(classes: tuple[int, ...], bits: np.ndarray):
    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    def run(batches):
        rows, chars = [], 0
        for batch in batches:
            for doc, mark, text in zip(*(batch.column(n) for n in ("doc_id", "mark", "text")), strict=True):
                doc, mark = doc.as_py(), mark.as_py()
                for found in found_pieces(text.as_py(), classes, bits):
                    rows.append((doc, mark, *found))
                    chars += 64 + len(found[3]) + len(found[4])
                    if chars > BATCH_CHARS:
                        yield table(rows)
                        rows, chars = [], 0
        if rows:
            yield table(rows)

    return run


def _anchored(batches):
    """One row per string: its class and where in it, with which hash, its anchor is."""
    for batch in batches:
        rows = []
        for text in batch.column("q"):
            text = text.as_py()
            c = string_class(len(text))
            if c < SAMPLED:
                at, hashes = 0, whole_hashes(gram_hashes(text, [1 << (c.bit_length() - 1)]), c)
            else:
                hashes = gram_hashes(text[:c], [GRAMS[c]])[GRAMS[c]]
                at = int(least_places(hashes, c - GRAMS[c] + 1)[0])
            rows.append((c, at, int(hashes[at : at + 1].view(np.int64)[0])))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        arrays = [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("q"), *arrays], names=["item_id", "q", "class", "at", "hash"])


def occurrences(docs: DataFrame, strings: DataFrame) -> DataFrame:
    """(item_id, doc_id, quote_start, quote_end) of each of (item_id, q) in each of (doc_id, text) that contains it.

    Strings of any length, also inside words; places count code points from 1, the end is
    inclusive and the first occurrence counts. Null texts and null or empty strings match
    nothing; repeated rows count once; rows without an id are found like any other, texts of
    one id are documents of their own; an empty table gives an empty result.
    """
    asked = strings.where(F.length("q") > 0).select(F.col("item_id").cast("long").alias("item_id"), "q").distinct()
    asked = stored(asked.mapInArrow(_anchored, "item_id long, q string, class int, at int, hash long"), "strings")
    classes = tuple(r[0] for r in asked.select("class").distinct().orderBy("class").collect())  # 42 at most
    body = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    pieces = body.mapInArrow(_found(classes, asked_bits(asked)), "doc_id long, mark long, class int, hash long, from int, around string, places array<int>")
    begins = F.transform("places", lambda p: p - F.col("at"))
    there = F.filter(begins, lambda p: (p >= 0) & (F.substring(F.col("around"), p + 1, F.length("q")) == F.col("q")))
    met = pieces.join(asked, ["class", "hash"]).select("doc_id", "mark", "item_id", "q", (F.col("from") + F.get(there, F.lit(0))).alias("start")).where(F.col("start").isNotNull())
    first = met.groupBy("doc_id", "mark", "item_id", "q").agg(F.min("start").alias("start"))
    return first.select("item_id", "doc_id", (F.col("start") + 1).cast("int").alias("quote_start"), (F.col("start") + F.length("q")).cast("int").alias("quote_end"))


#: Fixed value: a quote of fewer characters proves nothing.
LEAST_CHARS = 25


def repaired_spans(claims: DataFrame, docs: DataFrame, flat) -> DataFrame:
    """(claim_id, doc_id, verdict, quote_start, quote_end): claims whose quote really is in their document, with its true span.

    ``claims`` has (claim_id, doc_id, speaker, quote); ``flat`` flattens white space as the
    offsets count it. Verdicts are ``no_speaker``, ``short_quote``, ``not_verbatim`` and
    ``kept``; only the last has a span.
    """
    quote, at = flat(F.col("quote")), F.instr("flat", F.col("q"))
    rows = claims.withColumn("q", quote).join(docs.select("doc_id", flat(F.col("text")).alias("flat")), "doc_id")
    verdict = F.when(F.coalesce("speaker", F.lit("")) == "", "no_speaker").when(F.length("q") < LEAST_CHARS, "short_quote").when(at == 0, "not_verbatim").otherwise("kept")
    judged = rows.withColumn("verdict", verdict).withColumn("at", F.when(F.col("verdict") == "kept", at))
    return judged.select("claim_id", "doc_id", "verdict", F.col("at").alias("quote_start"), (F.col("at") + F.length("q") - 1).cast("int").alias("quote_end"))
