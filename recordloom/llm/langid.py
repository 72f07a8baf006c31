"""Language identification by nearest centroid, with rejection by distance.

A text becomes a normalised TF-IDF vector of hashed character 1-, 2- and 3-grams (lower
case, runs of anything but letters count as one space). Each language has several
centroids, found by spherical k-means over its own training texts; a text gets the
language of the centroid with the highest cosine. It is rejected where that cosine is
under ``reject_share`` of the median cosine that the language's own training texts reach
(scaled down for texts with few letters, whose vectors are sparse), or where the text has
no letter.

The classifier is fitted on a bounded sample of labelled rows: at most ``per_language``
texts of each of at most ``max_languages`` languages (the most frequent, of equal counts the
first in code point order), chosen by hash of doc_id, so the sample does not depend on
partitioning; one text (the least) of an id that repeats within a language. Their grams
are counted where they lie, and only the counts reach the driver. Prediction covers every
row and is map-only.

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; a
null lang is never learned from; with nothing to learn from, every text is ``und``; very
long texts are scanned in pieces of half a million characters, with all grams across
their edges; equal cosines go to the language first in code point order; repeated rows get
equal results; an empty table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.columns import Carried
from recordloom.llm.workers import lean

UND = "und"
DIMS = 4096
CLUSTERS = 4
PER_LANGUAGE = 300
MAX_LANGUAGES = 200
REJECT_SHARE = 0.35
#: Letters from which on a text's cosine is held to the full threshold.
FULL_LETTERS = 200
_CHARS_AT_ONCE = 1 << 19

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return _LETTER


def held_out(doc_id: Column) -> Column:
    """True for documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _gram_cells(seq: np.ndarray, dims: int, row: np.ndarray | None = None, tail: int = 0) -> list[np.ndarray]:
    """The cell of every 1-, 2- and 3-gram of ``seq`` that ends at or after ``tail``, within rows."""
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - (dims.bit_length() - 1))
    cells, gram = [], seq
    for n in range(3):
        if n:
            gram = (gram[:-1] * np.uint64(0x100000001B3)) ^ seq[n:]
        cell = (((gram + np.uint64(n)) * mix) >> shift).astype(np.int64)
        if row is not None:
            cell = (row[: len(cell)] * dims + cell)[row[n:] == row[: len(cell)]]
        cells.append(cell[max(0, tail - n) :])
    return cells


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _long_counts(lowered: str, dims: int) -> tuple[np.ndarray, int]:
    """``gram_counts`` of one text, piece by piece; the last two characters of a piece go on to the next."""
    counts, letters = np.zeros(dims, np.int64), 0
    tail, before = np.zeros(0, np.uint64), False
    for at in range(0, len(lowered), _CHARS_AT_ONCE):
        code = _codes(lowered[at : at + _CHARS_AT_ONCE])
        is_letter = _letters()[code]
        letters += int(is_letter.sum())
        code[~is_letter] = 32
        seq = np.concatenate((tail, code[is_letter | np.concatenate(([before], is_letter[:-1]))]))
        counts += np.bincount(np.concatenate(_gram_cells(seq, dims, tail=len(tail))), minlength=dims)
        tail, before = seq[-2:], bool(is_letter[-1])
    return counts, letters


def gram_counts(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-gram counts (texts x dims) and the number of letters of each text.

    A run of other characters after a letter counts as one space, one before the first letter not at all.
    """
    counts = np.zeros((len(texts), dims), np.float32)
    letters = np.zeros(len(texts), np.int64)
    flat = counts.ravel()
    rows, codes, size = [], [], 0

    def flush():
        nonlocal rows, codes, size
        if not rows:
            return
        lens = np.array([len(c) for c in codes])
        code = np.concatenate(codes)
        row = np.repeat(np.array(rows, np.int64), lens)
        is_letter = _letters()[code]
        letters[rows] = np.add.reduceat(is_letter, np.concatenate(([0], np.cumsum(lens)[:-1])), dtype=np.int64)
        code[~is_letter] = 32
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
        low = rows[0] * dims
        found = np.bincount(np.concatenate(_gram_cells(code[keep], dims, row[keep])) - low, minlength=(rows[-1] + 1) * dims - low)
        flat[low : low + len(found)] += found
        rows, codes, size = [], [], 0

    for i, text in enumerate(texts):
        lowered = text.lower()
        if len(lowered) > _CHARS_AT_ONCE:
            counts[i], letters[i] = _long_counts(lowered, dims)
        elif lowered:
            rows.append(i)
            codes.append(_codes(lowered))
            size += len(lowered)
            if size >= _CHARS_AT_ONCE or len(rows) >= 256:
                flush()
    flush()
    return counts, letters


@dataclass
class Centroids:
    """A fitted classifier."""

    langs: list[str]
    centre: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    typical: np.ndarray
    reject_share: float = REJECT_SHARE

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            counts, letters = gram_counts(part, self.centre.shape[1])
            cos = self.vectors(counts) @ self.centre.T
            best = cos.argmax(axis=1)
            for i, b in enumerate(best):
                if not letters[i]:
                    langs.append(UND)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                own = int(self.owner[b])
                score = float(min(1.0, max(0.0, cos[i, b])))
                floor = self.reject_share * self.typical[own] * min(1.0, letters[i] / FULL_LETTERS)
                langs.append(self.langs[own])
                scores.append(score)
                rejected.append(score < floor)
        return langs, scores, rejected


def packed(text: str, dims: int = DIMS) -> bytes:
    """A text's gram counts as (cell, count) pairs after its number of letters."""
    counts, letters = gram_counts([text], dims)
    cell = np.flatnonzero(counts[0])
    return np.concatenate(([letters[0]], cell, counts[0][cell])).astype("<i8").tobytes()


def _unpacked(blobs: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    counts, letters = np.zeros((len(blobs), dims), np.float32), np.zeros(len(blobs), np.int64)
    for i, blob in enumerate(blobs):
        values = np.frombuffer(blob, "<i8")
        half = len(values) // 2
        letters[i], counts[i, values[1 : half + 1]] = values[0], values[half + 1 :]
    return counts, letters


def fit(samples: list[tuple[str, bytes]], clusters: int = CLUSTERS, dims: int = DIMS, rounds: int = 12, reject_share: float = REJECT_SHARE) -> Centroids | None:
    """Fit on (lang, packed gram counts) pairs; the same pairs in any order give the same centroids."""
    samples = sorted(samples)
    if not samples:
        return None
    counts, letters = _unpacked([blob for _, blob in samples], dims)
    seen = letters > 0
    if not seen.any():
        return None
    names = np.array([lang for lang, _ in samples])[seen]
    counts = counts[seen]
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.05).astype(np.float32)
    model = Centroids(sorted(set(names)), np.zeros((0, dims), np.float32), np.zeros(0, np.int64), idf, np.zeros(0), reject_share)
    x = model.vectors(counts)
    centres, owners, typical = [], [], []
    for n, lang in enumerate(model.langs):
        own = x[names == lang]
        k = min(clusters, len(own))
        picked = [int(np.argmax(own @ own.mean(axis=0)))]
        while len(picked) < k:  # the text farthest from all centres so far
            picked.append(int(np.argmin((own @ own[picked].T).max(axis=1))))
        centre = own[picked]
        for _ in range(rounds):
            at = (own @ centre.T).argmax(axis=1)
            moved = np.array([own[at == j].mean(axis=0) if (at == j).any() else centre[j] for j in range(k)])
            moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
            if np.allclose(moved, centre):
                break
            centre = moved
        centres.append(centre)
        owners += [n] * k
        typical.append(float(np.median((own @ centre.T).max(axis=1))))
    model.centre, model.owner, model.typical = np.concatenate(centres).astype(np.float32), np.array(owners), np.array(typical)
    return model


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, dims: int = DIMS) -> list[tuple[str, bytes]]:
    """At most ``per_language`` (lang, packed gram counts) pairs of each language, by hash of doc_id.

    The ids are chosen on narrow columns, in two levels, so that no task sees more of a
    language than its best of each of 64 deals; only the chosen rows' texts are read.
    """
    open_rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    most = open_rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
    chosen = open_rows.select("doc_id", "lang").distinct().join(F.broadcast(most), "lang")  # at most max_languages rows
    for keys in (["lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))], ["lang"]):
        by_hash = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= per_language).drop("nth")
    picked = chosen.collect()
    if not picked:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, chosen.schema))  # at most per_language * max_languages rows
    texts = open_rows.join(few, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        for batch in batches:
            blobs = [packed(t.as_py(), dims) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(blobs, pa.binary())], names=["lang", "grams"])

    return [(r["lang"], bytes(r["grams"])) for r in texts.mapInArrow(lean(count), "lang string, grams binary").collect()]


def identify(docs: DataFrame, model: Centroids | None, passing: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row, with the ``passing`` columns unchanged."""
    fields = [f for f in docs.select("doc_id", *passing).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, rejected boolean"
    keep = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                langs, scores, out = model.predict(texts) if model else ([UND] * len(texts), [0.0] * len(texts), [True] * len(texts))
                columns = [part.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select("text", *keep).mapInArrow(lean(run), schema) if "text" not in keep else docs.select(*keep).mapInArrow(lean(run), schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that language identification does not reject, columns unchanged.

    Rejected are texts without letters and texts far from every centroid. With no labelled
    row to learn from, nothing is rejected but texts without letters.
    """
    model = fit(training_sample(docs))
    if model is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    carried = Carried(docs, "doc_id", "text")
    return carried.back(identify(carried.df, model, ("text", *carried.others())).where(~F.col("rejected")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's predictions over all of ``documents``; ``rejected`` is an extra column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(training_sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
