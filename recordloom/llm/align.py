"""Alignment of two tokenizations of the same text, and how often their ids meet.

Both token sequences spell the same bytes. Per text a label string with one letter a byte
says what ends there: nothing, a token of A, one of B, or one of each. A regular
expression scans it for spans up to each both-letter; the numbers of end letters in a span
are the numbers of tokens of either side in that group. A link is a pair of tokens that
share bytes; as tokens leave no gaps, every byte where anything ends closes exactly one
link, so the label string gives them in order too.

Corpus-wide counts of linked id pairs come back to the documents without a row for each
document and pair: tasks number the distinct pairs of a chunk of documents, documents
keep those numbers, and only the chunk's list of pairs is shuffled, summed per pair and
joined back. A chunk is ended by its bytes of text or number of pairs; the pairs of one B
id, which its highest count is taken over, are at most the ids of A.

Defined cases: texts that are null, empty, or that either side doesn't spell byte for byte
have no tokens, zeros and an empty digest; the strings of special tokens are plain text; a
very long text is aligned whole and may be a chunk by itself; repeated rows and rows
without doc_id count like any other; equal counts of one B id are all its highest; sums
beyond a long take the largest long; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import packing
from recordloom.llm.workers import lean
from recordloom.storage import stored

CHUNK_BYTES = 16_000_000
CHUNK_PAIRS = 1_000_000
#: Entries of a chunk's list that travel in one row.
LISTED = 50_000
_ROWS = 2_000
_SPAN = re.compile(b"[^x]*x")
_MOST = (1 << 63) - 1


class ByteLevel:
    """The byte-level side: ids of a text, special tokens' strings as plain text, and the bytes of each id."""

    def __init__(self, path: str, ranks: str | None = None):
        self.ids_of = _PlainIds(path, ranks)
        with open(path, encoding="utf-8") as lines:
            vocabulary = json.load(lines)["model"]["vocab"]
        # bytes that print stand for themselves, the others for the characters from 256 on
        prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        byte_of = {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
        self.bytes_of = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            if all(c in byte_of for c in entry):
                self.bytes_of[i] = bytes(byte_of[c] for c in entry)

    def __call__(self, text: str) -> list[int]:
        return self.ids_of(" " + text)


class _PlainIds(packing.TokenIds):
    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and packing._COMMON.fullmatch(text) and not packing._BLANKS.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            import tokenizers

            self.slow = tokenizers.Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """The piece side, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [
            b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text)


@dataclass(frozen=True)
class Alignment:
    """Ids of both sides, tokens of each side per group, and the linked ids in order."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    linked_a: np.ndarray
    linked_b: np.ndarray

    def groups(self) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        # every token as text with the mark that follows it, put where its group begins
        out = np.empty(len(self.a) + len(self.b), object)
        upto_a, upto_b = np.cumsum(self.a_sizes), np.cumsum(self.b_sizes)
        ends = np.zeros(len(self.a), np.int64)
        ends[upto_a - 1] = 1
        out[np.arange(len(self.a)) + np.repeat(upto_b - self.b_sizes, self.a_sizes)] = _texts("|", self.a)[2 * self.a + ends]
        ends = np.zeros(len(self.b), np.int64)
        ends[upto_b - 1] = 1
        out[np.arange(len(self.b)) + np.repeat(upto_a, self.b_sizes)] = _texts(";", self.b)[2 * self.b + ends]
        return "".join(out.tolist())[:-1]


_written: dict[str, np.ndarray] = {}


def _texts(mark: str, ids: np.ndarray) -> np.ndarray:
    """Ids as text: at 2 * id followed by a comma, behind it by ``mark``."""
    have = _written.get(mark, np.empty(0, object))
    if len(ids) and 2 * int(ids.max()) >= len(have):
        have = np.array([f"{i}{m}" for i in range(max(1 << 15, 2 * int(ids.max()))) for m in (",", mark)], object)
        _written[mark] = have
    return have


class _Sizes(dict):
    """Tokens of one side in a span of end letters; short spans are kept."""

    def __init__(self, letter: bytes):
        super().__init__()
        self.letter = letter

    def __missing__(self, span: bytes) -> int:
        found = 1 + span.count(self.letter)
        if len(span) <= 4:
            self[span] = found
        return found


_sizes_a, _sizes_b = _Sizes(b"a"), _Sizes(b"b")
_NOTHING = Alignment(*(np.zeros(0, np.int64) for _ in range(6)))


class Aligner:
    def __init__(self, left, right):
        self.left, self.right = left, right
        self.left_sizes, self.right_sizes = (np.array([len(b) for b in side.bytes_of], np.int64) for side in (left, right))

    def __call__(self, text: str | None) -> Alignment:
        if not text:
            return _NOTHING
        raw = (" " + text).encode("utf-8", "replace")
        a, b = self.left(text), self.right(text)
        if any(b"".join(map(side.bytes_of.__getitem__, ids)) != raw for side, ids in ((self.left, a), (self.right, b))):
            return _NOTHING
        at_a, at_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        ends_a[np.cumsum(self.left_sizes[at_a]) - 1] = True
        ends_b[np.cumsum(self.right_sizes[at_b]) - 1] = True
        labels = np.frombuffer(b".abx", np.uint8)[ends_a + 2 * ends_b].tobytes()
        # bytes where nothing ends count for nothing in a span
        spans = _SPAN.findall(labels.translate(None, b"."))
        a_sizes, b_sizes = (np.fromiter(map(sizes.__getitem__, spans), np.int64, len(spans)) for sizes in (_sizes_a, _sizes_b))
        ends = np.flatnonzero(ends_a | ends_b)
        # the tokens that cover an end are those after all earlier ends of their side
        nth_a = np.cumsum(ends_a[ends]) - ends_a[ends]
        nth_b = np.cumsum(ends_b[ends]) - ends_b[ends]
        return Alignment(at_a, at_b, a_sizes, b_sizes, at_a[nth_a], at_b[nth_b])


def public_paths() -> tuple[str, str, str]:
    """The installed byte-level vocabulary as tokenizer file and as ranks, and the piece model."""
    import public_tokenizers

    return *packing.tokenizer_paths(), public_tokenizers.path("piece_bpe_32k.model")


def _aligner(paths) -> Aligner:
    return Aligner(ByteLevel(*paths[:2]), Pieces(paths[2]))


def _two_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def aligned(docs: DataFrame, paths: tuple[str, str | None, str] | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_sizes, b_sizes (tokens of each side per group): map-only."""
    paths = paths or public_paths()
    types = pa.schema([("doc_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("a_ids", "b_ids", "a_sizes", "b_sizes"))])

    def run(batches):
        align = _aligner(paths)
        for batch in batches:
            for lo in range(0, len(batch), _ROWS):
                part = batch.slice(lo, _ROWS)
                found = [align(t.as_py()) for t in part.column("text")]
                columns = [[f.a for f in found], [f.b for f in found], [f.a_sizes for f in found], [f.b_sizes for f in found]]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(types)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], schema=types)

    return _two_columns(docs).mapInArrow(lean(run), "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


class _Chunk:
    """The distinct pairs of some documents, numbered as they come, and their counts there."""

    def __init__(self, name: int):
        self.name, self.bytes = name, 0
        self.number: dict[int, int] = {}
        self.count: list[int] = []

    def add(self, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        at = []
        for pair, n in zip(pairs.tolist(), times.tolist(), strict=True):
            i = self.number.setdefault(pair, len(self.count))
            if i == len(self.count):
                self.count.append(n)
            else:
                self.count[i] += n
            at.append(i)
        return np.array(at, "<u4")

    def full(self) -> bool:
        return self.bytes >= CHUNK_BYTES or len(self.count) >= CHUNK_PAIRS


_MEASURED = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary()), ("base", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_MEASURED_SQL = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "at binary, times binary, base long, pairs array<long>, counts array<long>"
)


def _rows(some: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _MEASURED, strict=True)], schema=_MEASURED)


def _measured(paths):
    """Rows of documents, each with its pairs by number, and rows of what a chunk's numbers stand for."""

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        align = _aligner(paths)
        task = TaskContext.get().partitionId() << 28
        chunk, some = _Chunk(task), []

        def closed():
            pairs = list(chunk.number)
            for lo in range(0, len(pairs), LISTED):
                yield _rows([(chunk.name, *[None] * 8, lo, pairs[lo : lo + LISTED], chunk.count[lo : lo + LISTED])])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                found = align(text)
                pairs, times = np.unique(found.linked_a << 32 | found.linked_b, return_counts=True)
                digest = hashlib.sha256(found.groups().encode()).hexdigest() if len(found.a) else ""
                at = chunk.add(pairs, times)
                some.append((chunk.name, doc, len(found.a), len(found.b), len(found.a_sizes), len(found.linked_a), digest, at.tobytes(), times.astype("<u4").tobytes(), None, None, None))
                chunk.bytes += len(text or "")
                if len(some) >= _ROWS or chunk.full():
                    yield _rows(some)
                    some = []
                if chunk.full():
                    yield from closed()
                    chunk = _Chunk(chunk.name + 1)
        if some:
            yield _rows(some)
        yield from closed()

    return run


def _weighed(count: np.ndarray, times: np.ndarray) -> int:
    if float(count.astype(np.float64) @ times) < 2.0**62:
        return int(count @ times)
    return min(_MOST, sum(c * n for c, n in zip(count.tolist(), times.tolist(), strict=True)))


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _looked_up(batches: Iterable[pa.RecordBatch]):
    """Rows sorted by chunk, first what its numbers stand for, then its documents."""
    chunk, count, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        keys = batch.column("chunk").to_numpy()
        ends = [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        n_best, sums = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        docs = batch.column("is_doc").to_numpy(zero_copy_only=False)
        at, times = batch.column("at"), batch.column("times")
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if keys[lo] != chunk:
                chunk, count, best = keys[lo], np.zeros(0, np.int64), np.zeros(0, bool)
            listed = batch.slice(lo, hi - lo).filter(pa.array(~docs[lo:hi]))
            if len(listed):
                number = listed.column("number").to_numpy(zero_copy_only=False).astype(np.int64)
                if (need := int(number.max()) + 1) > len(count):
                    size = max(need, 2 * len(count))
                    count, best = np.resize(count, size), np.resize(best, size)
                count[number] = listed.column("count").to_numpy(zero_copy_only=False)
                best[number] = listed.column("best").to_numpy(zero_copy_only=False)
            for i in lo + np.flatnonzero(docs[lo:hi]):
                here, n = np.frombuffer(at[i].as_py(), "<u4"), np.frombuffer(times[i].as_py(), "<u4").astype(np.int64)
                n_best[i], sums[i] = int(n[best[here]].sum()), _weighed(count[here], n)
        found = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"n_best": pa.array(n_best), "count_sum": pa.array(sums)}
        yield pa.RecordBatch.from_arrays([found[n] for n in _NAMES], names=_NAMES).filter(pa.array(docs))


def link_counts(docs: DataFrame, paths: tuple[str, str | None, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' digests and the corpus' id pairs.

    First: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row
    per document. Second: a_id, b_id, count, best (count is the highest of its B id).
    """
    measured = stored(_two_columns(docs).mapInArrow(lean(_measured(paths or public_paths())), _MEASURED_SQL), "alignments")
    listed = measured.where(F.col("pairs").isNotNull()).select(
        "chunk", "base", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "entry")
    ).select("chunk", (F.col("base") + F.col("place")).alias("number"), F.col("entry.pairs").alias("pair"), F.col("entry.counts").alias("n"))
    of_b = Window.partitionBy("b_id")
    low = F.lit((1 << 32) - 1)
    totals = (
        listed.groupBy("pair").agg(F.sum("n").alias("count"))
        .select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(low).alias("b_id"), "count")
        .withColumn("best", F.col("count") == F.max("count").over(of_b))
    )
    totals = stored(totals, "pairs")
    slices = listed.select("chunk", "number", "pair").join(totals.select("pair", "count", "best"), "pair").drop("pair")
    rows = measured.where(F.col("pairs").isNull()).select(
        "chunk", F.lit(True).alias("is_doc"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times"
    )
    together = rows.unionByName(slices.withColumn("is_doc", F.lit(False)), allowMissingColumns=True)
    digests = together.repartition("chunk").sortWithinPartitions("chunk", "is_doc").mapInArrow(
        lean(_looked_up), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
    return digests, totals.select("a_id", "b_id", "count", "best")


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """The contract's digests over all of ``documents``."""
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
