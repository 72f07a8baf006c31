"""Fill-in-the-middle: documents cut at two drawn unit boundaries and put in another order.

A unit is a word with the blanks before it, or the blanks at the end of a text. While the
units of a text are counted, block of bytes by block of bytes, an index of sparse
checkpoints is kept: every ``step`` units the number of units, of bytes and of code points
so far. The cuts are drawn only when the number of units is known; each is then found by
binary search among the checkpoints and a scan of fewer than ``step`` units from there, so
no list of all units or offsets is ever held.

Which form a document takes and where it is cut follow from the hash of seed and doc_id
alone, so reruns, retries and other partitionings agree. Map-only.

Defined cases: a null text is empty; an empty text, or one that holds a mark, stays plain,
as marks could not be told apart in it; a text of a million blanks or without any is one
unit; a middle, prefix or suffix may be empty; rows of equal doc_id are cut by the same
draws; a row without doc_id draws as if its id were the empty string; an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.workers import lean

SEED = 42
#: Of 100 documents so many are transformed, and of these so many have the suffix first.
RATE = 50
SUFFIX_FIRST = 80
STEP = 64
BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_OUT_BYTES = 4_000_000


def _points(raw: np.ndarray) -> int:
    """Code points that begin in these UTF-8 bytes."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


class Checkpoints:
    """The units of a text: their number, and where any of them ends."""

    def __init__(self, raw: bytes, step: int = STEP, block: int = BLOCK):
        self.raw, self.step = raw, step
        self.units, self.bytes, self.points = [0], [0], [0]
        self.n = 0
        seen = np.frombuffer(raw, np.uint8)
        points = 0
        for lo in range(0, len(raw), block):
            part = seen[lo : lo + block]
            blank = _BLANK[part]
            # a word ends before a blank or with the text; blanks at the text's end are a unit too
            after = np.append(blank[1:], _BLANK[seen[lo + len(part)]] if lo + len(part) < len(raw) else True)
            ends = np.flatnonzero(~blank & after) + 1
            if lo + len(part) == len(raw) and blank[-1]:
                ends = np.append(ends, len(part))
            marks = ends[(-self.n - 1) % step :: step]
            begun = np.cumsum(np.add.reduceat((part & 0xC0) != 0x80, np.append(0, marks[marks < len(part)]), dtype=np.int64))
            first = self.n + (-self.n - 1) % step + 1
            self.units += range(first, first + step * len(marks), step)
            self.bytes += (lo + marks).tolist()
            self.points += (points + begun[: len(marks)]).tolist()
            self.n += len(ends)
            points += _points(part)

    def end_of(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the first ``unit`` units."""
        at = bisect_right(self.units, unit) - 1
        here, points = self.bytes[at], self.points[at]
        end = here
        for _ in range(unit - self.units[at]):
            end = _UNIT.match(self.raw, end).end()
        return end, points + _points(np.frombuffer(self.raw, np.uint8, end - here, here))


@dataclass(frozen=True)
class Recipe:
    seed: int = SEED
    rate: int = RATE
    suffix_first: int = SUFFIX_FIRST
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)
    step: int = STEP

    def cut(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, code points of the prefix, of the middle, output)."""
        raw = text.encode("utf-8", "surrogatepass")
        index = Checkpoints(raw, self.step)
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not text or h3 % 100 >= self.rate or any(m in text for m in self.marks):
            return index.n, "plain", None, None, text
        low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
        (a, a_points), (b, b_points) = index.end_of(low), index.end_of(high)
        prefix, middle, suffix = (raw[i:j].decode("utf-8", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(raw))))
        p, s, m = self.marks
        if h4 % 100 < self.suffix_first:
            return index.n, "spm", a_points, b_points - a_points, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return index.n, "psm", a_points, b_points - a_points, f"{p}{prefix}{s}{suffix}{m}{middle}"


_FIELDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def transformed(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output: one row per document."""

    def run(batches):
        def rows(some):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _FIELDS.values(), strict=True)], names=[*_FIELDS])

        some, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                some.append((doc, *recipe.cut(doc, text.as_py() or "")))
                size += len(some[-1][-1])
                if size > _OUT_BYTES:
                    yield rows(some)
                    some, size = [], 0
        if some:
            yield rows(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made of; no text that holds a mark is ever cut, so each occurs once."""
    p, s, m = (F.lit(x) for x in marks)
    middle = F.split_part(output, m, F.lit(2))
    fore = F.split_part(output, m, F.lit(1))
    psm = F.concat(F.split_part(F.split_part(fore, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(fore, s, F.lit(2)))
    spm = F.concat(F.split_part(fore, p, F.lit(2)), middle, F.split_part(F.split_part(fore, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The contract's digests over all of ``documents``."""
    made = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), h AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:], '') AS suffix
  FROM f
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
