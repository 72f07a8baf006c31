"""Best-fit packing of token pieces into sequences of a fixed length.

Each task tokenises its documents and packs their pieces online into a bounded number of
open bins; of the pieces of one batch the largest come first. A bitset keyed by free space holds which free spaces occur; the best fit for a
piece of n tokens is the lowest set bit at or above n, one shift and one mask. When no
open bin fits and all are in use, the fullest (the lowest set bit of all) closes.

Bins that are still open when a task ends are not wasted: they are packed again, as
pieces of their own, largest first, in tasks that gather a bounded number of them. Pieces
of a full sequence's length need no bin.

Token ids come from the tokenizer file; texts made of common Latin characters take
a faster library with the same vocabulary and pattern, which gives the same ids. That
library gives up on very long runs of blanks, so texts with one go by the tokenizer file.

Defined cases: a null or empty text is the end id alone; documents longer than a sequence
are cut so that all pieces but the first are full; repeated rows and rows without doc_id
are packed like any other; a text of any length (a word or a run of blanks of a million
characters too) is encoded whole; an empty table gives an empty result; only doc_id and
text are read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.workers import lean
from recordloom.storage import stored

LENGTH = 1024
END_ID = 2
OPEN_BINS = 512
#: Leftover bins that one task packs again.
BINS_PER_TASK = 200_000
#: Characters on which both tokenizer libraries split alike.
_COMMON = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARK = "<|endoftext|>"
#: A run of blanks beyond what the faster library's pattern engine takes.
_BLANKS = re.compile(r"(?<!\s)\s{10001}")


class Bins:
    """A fixed number of open bins in a bitset keyed by free space; ``put`` gives (bin, offset)."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN_BINS):
        self.length, self.most_open = length, most_open
        self.bits = 0
        self.by_free: list[deque] = [deque() for _ in range(length + 1)]
        self.n_open = self.n_bins = 0

    def put(self, size: int) -> tuple[int, int]:
        if size > self.length:
            raise ValueError(f"a piece of {size} does not fit {self.length}")
        if size == self.length:
            self.n_bins += 1
            return self.n_bins - 1, 0
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id = self.length, self.n_bins
            self.n_bins += 1
        if free > size:
            left = free - size
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.length - free

    def _take(self, free: int) -> int:
        queue = self.by_free[free]
        bin_id = queue.popleft()
        if not queue:
            self.bits ^= 1 << free
        self.n_open -= 1
        return bin_id

    def open_bins(self) -> set[int]:
        return {b for queue in self.by_free for b in queue}


class TokenIds:
    """Ids of a text by the tokenizer file at ``path``, and the same ids faster where ``ranks`` allows."""

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self.slow, self.fast = path, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and _COMMON.fullmatch(text) and _MARK not in text and not _BLANKS.search(text):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            import tokenizers

            self.slow = tokenizers.Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def tokenizer_paths() -> tuple[str, str]:
    """The installed public byte-level vocabulary, as tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


_FIELDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "bin": pa.int64(), "offset": pa.int64(), "open": pa.bool_()}
_HELD_ROWS = 20_000


def _packed(paths, length, end_id, most_open):
    def run(batches):
        from pyspark import TaskContext

        ids = TokenIds(*paths)
        bins = Bins(length, most_open)
        task = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def rows(some, is_open):
            columns = zip(*[(*r[:5], task + r[5], r[6], is_open) for r in some], strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*_FIELDS])

        for batch in batches:
            ahead = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                row = np.array([*ids(text.as_py() or ""), end_id], "<u4")
                for n, (start, size) in enumerate(cuts(len(row), length)):
                    ahead.append((doc, n, start, size, zlib.crc32(row[start : start + size].tobytes())))
            ahead.sort(key=lambda r: -r[3])  # of what has arrived, the largest first
            held += [(*r, *bins.put(r[3])) for r in ahead]
            if len(held) > _HELD_ROWS:  # bins that have closed do not change any more
                still = bins.open_bins()
                if done := [r for r in held if r[5] not in still]:
                    yield rows(done, False)
                    held = [r for r in held if r[5] in still]
        still = bins.open_bins()
        for is_open in (False, True):
            if some := [r for r in held if (r[5] in still) == is_open]:
                yield rows(some, is_open)

    return run


def _repacked(length, most_open):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = Bins(length, most_open)
        for batch in batches:
            places = [bins.put(size) for size in batch.column("filled").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("old"), pa.array([-1 - ((task << 36) + b) for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                names=["old", "sequence_id", "shift"],
            )

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, most_open: int = OPEN_BINS, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lean(_packed(paths or tokenizer_paths(), length, end_id, most_open)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean",
    )
    pieces = stored(pieces, "pieces")
    left = pieces.where("open").groupBy(F.col("bin").alias("old")).agg(F.max(F.col("offset") + F.col("length")).alias("filled"))
    left = stored(left, "bins")
    tasks = max(1, -(-left.count() // BINS_PER_TASK))
    again = (
        left.repartition(tasks, F.xxhash64("old")) if tasks > 1 else left.coalesce(1)
    ).sortWithinPartitions(F.desc("filled"), "old").mapInArrow(_repacked(length, 4 * most_open), "old long, sequence_id long, shift long")
    closed = pieces.where(~F.col("open")).withColumn("sequence_id", F.col("bin"))
    moved = pieces.where("open").join(again, F.col("bin") == F.col("old")).withColumn("offset", F.col("offset") + F.col("shift"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return closed.select(names).unionByName(moved.select(names))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's pieces over all of ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
