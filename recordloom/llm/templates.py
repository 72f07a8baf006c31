"""Line dedup by a log-template tree.

A line's tokens that carry digits are variable fields at once (``<*>``). The tree has a
fixed depth: lines part by token count, then by their leading tokens. In a leaf, lines
are parsed in a fixed order (most documents first, then by text): a line joins the first
template most of whose tokens it shares in place, and the template turns the tokens that
differ into variable fields. A template that occurs in ``min_docs`` documents or more
recurs; every document but the first that has it (smallest doc_id) loses its lines. A long
line, of ``long_tokens`` tokens or ``long_chars`` characters, recurs from its second
document on where it is the same to the letter. Only copies as a whole keep such lines, for
the operators that group copies: where a document equals the first one that has the line,
or shares with it long lines of at least ``copy_share`` of the characters that either has.

The tree works on distinct masked lines, counted map-side, so a line that every document
repeats is one row. Its depth is the same at every size: a leaf is parsed whole, and beyond
``max_leaf`` templates a line looks its template up by blocks of tokens, one of which it
must share with every template within reach, so the result is that of comparing with each.
Only leaves whose lines could recur together are parsed in Python.

Defined cases: a null text has no lines and stays null; an empty text is one empty line;
lines of fewer than ``min_tokens`` tokens that are not long are never dropped; the first
document keeps all its lines of a template; a line is told by the 64-bit hash of its masked
form; rows of equal doc_id are one document, a null doc_id counts as one document that
comes last; dropping takes time in proportion to a text's lines, however long it is; an
empty table gives an empty result; further columns pass through unchanged, whatever their
names.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.columns import Carried
from recordloom.storage import stored

MIN_DOCS = 10
MIN_TOKENS = 3
LEADING = 3
SHARE = 0.7
#: From here on a line that repeats to the letter recurs from its second document on.
LONG_TOKENS = 50
LONG_CHARS = 300
#: Above what five-word shingles call near copies, as a few characters of their own cost two texts many shingles.
COPY_SHARE = 0.85
#: Templates of a leaf from which on they are looked up by blocks of tokens.
MAX_LEAF = 1000
FIELD = "<*>"
#: Stands for a missing doc_id, after all others.
_LAST = (1 << 63) - 1


def masked(line: Column) -> Column:
    """The line's tokens, joined by one space, with those that hold digits as fields."""
    plain = F.trim(F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, r"[^\s0-9]*[0-9]\S*", FIELD)).otherwise(plain)


def _tokens(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _leaf(line: Column, leading: int, *more: Column) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", leading), *more)


def line_rows(docs: DataFrame, leading: int = LEADING, long_tokens: int = LONG_TOKENS, long_chars: int = LONG_CHARS) -> DataFrame:
    """(d, mark, pos, line, leaf, whole, size, total): each line that may be dropped.

    ``d`` is the doc_id, or the last of all ids, and ``mark`` the hash of the text, which
    tells rows of one doc_id apart. ``line`` and ``leaf`` are the hashes of the masked form
    and of its leaf, null for lines of few tokens; ``whole`` is that of a long line itself,
    ``size`` its length and ``total`` its text's.
    """
    base = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("mark"), F.length("text").alias("total"), "text")
    lines = base.select("d", "mark", "total", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    # a filter on a nondeterministic column stays above the projection, so a line is masked once and not again in the filter
    rows = lines.select("d", "mark", "total", "pos", "raw", masked(F.col("raw")).alias("m"), F.spark_partition_id().alias("_once")).where((F.length("m") > 0) & (F.col("_once") >= 0))
    rows = rows.withColumn("n", _tokens(F.col("m"))).where((F.col("n") >= MIN_TOKENS) | (F.length("raw") >= long_chars))
    many, long = F.col("n") >= MIN_TOKENS, (F.col("n") >= long_tokens) | (F.length("raw") >= long_chars)
    return rows.select(
        "d", "mark", "pos", F.when(many, F.xxhash64("m")).alias("line"), F.when(many, _leaf(F.col("m"), leading)).alias("leaf"), F.when(long, F.xxhash64("raw")).alias("whole"), F.when(long, F.length("raw")).alias("size"), F.when(long, F.col("total")).alias("total")
    )


class _Blocks:
    """A leaf's templates by blocks of their tokens.

    A line that shares enough tokens with a template differs from it in fewer places than
    there are blocks, so it equals the template in one block at least.
    """

    def __init__(self, templates: list[list[str]], share: float):
        width = len(templates[0])
        self.need = next(n for n in range(width + 1) if n >= share * width)
        count = width - self.need + 1
        places = [i for i in range(width) if len({t[i] for t in templates}) > 1]
        self.blocks = [places[b::count] for b in range(count)] if len(places) >= count else [[]]
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((2 * len(templates), width), np.int32)
        self.at: dict[tuple, array] = {}
        for n, template in enumerate(templates):
            self.put(n, template)

    def _keys(self, row: list[int]) -> list[tuple]:
        return [(b, *[row[i] for i in block]) for b, block in enumerate(self.blocks)]

    def put(self, n: int, template: list[str]) -> None:
        """Enter template ``n``, or enter it anew after it changed; old entries do no harm."""
        if n >= len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        row = [self.numbers.setdefault(t, len(self.numbers)) for t in template]
        self.rows[n] = row
        for key in self._keys(row):
            self.at.setdefault(key, array("q")).append(n)

    def first(self, tokens: list[str]) -> list[int]:
        """The first template that shares enough tokens with the line, if any does."""
        row = [self.numbers.get(t, -1) for t in tokens]
        found = [np.array(self.at[key]) for key in self._keys(row) if key in self.at]
        if not found:
            return []
        near = np.concatenate(found)
        near = near[(self.rows[near] == np.array(row)).sum(axis=1) >= self.need]
        return [int(near.min())] if len(near) else []


def _parse_leaf(lines: list[tuple], share: float, max_leaf: int = MAX_LEAF) -> list[str]:
    """The template of each line, parsed in the order given."""
    templates: list[list[str]] = []
    members: list[int] = []
    blocks = None
    for line, *_ in lines:
        tokens = line.split(" ")
        if blocks is None and len(templates) > max_leaf:
            blocks = _Blocks(templates, share)
        for n in range(len(templates)) if blocks is None else blocks.first(tokens):
            template = templates[n]
            same = sum(a == b for a, b in zip(tokens, template, strict=True))
            if same >= share * len(tokens):
                if same < len(tokens):
                    grown = [a if a == b else FIELD for a, b in zip(tokens, template, strict=True)]
                    if blocks is not None and grown != template:
                        blocks.put(n, grown)
                    templates[n] = grown
                members.append(n)
                break
        else:
            templates.append(tokens)
            members.append(len(templates) - 1)
            if blocks is not None:
                blocks.put(len(templates) - 1, tokens)
    joined = [" ".join(t) for t in templates]
    return [joined[n] for n in members]


def templates(rows: DataFrame, share: float = SHARE, max_leaf: int = MAX_LEAF) -> DataFrame:
    """(line, template) of lines that are parsed together with others.

    ``rows`` has (line, leaf, masked, n_docs), one row per distinct masked line.
    """

    def as_batch(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["line", "template"])

    def run(batches):
        def flush():
            nonlocal group
            group.sort(key=lambda g: (-g[1], g[0]))
            found = _parse_leaf(group, share, max_leaf) if group else []
            out = [(g[2], t) for g, t in zip(group, found, strict=True)]
            group = []
            return out

        group, at, done = [], None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leaf", "masked", "n_docs", "line")]
            for leaf, text, n, line in zip(*columns, strict=True):
                if leaf != at:
                    done += flush()
                    at = leaf
                group.append((text, n, line))
            if done:
                yield as_batch(done)
                done = []
        if done := flush():
            yield as_batch(done)

    dealt = rows.select("leaf", "masked", "n_docs", "line").repartition("leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(run, "line long, template string")


def recurring(docs: DataFrame, rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_leaf: int = MAX_LEAF) -> DataFrame:
    """(line, first_doc, n_docs): the lines (by hash) whose template recurs across documents.

    Counting runs on hashes; only lines of leaves that could recur together are looked up
    in their first document's text.
    """
    rows = rows.where(F.col("line").isNotNull())
    in_doc = rows.groupBy("line", "leaf", "d").agg(F.min(F.struct("mark", "pos")).alias("at"))
    counted = stored(in_doc.groupBy("line", "leaf").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("d", "at.mark", "at.pos")).alias("first")), "counted")
    leaves = counted.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n_docs").alias("sum_docs"))
    # lines that can't reach min_docs even together, or have no other line beside them, need no parsing
    leaves = leaves.where((F.col("n_lines") > 1) & (F.col("sum_docs") >= min_docs)).select("leaf")
    asked = counted.join(leaves, "leaf", "left_semi").groupBy("first.d", "first.mark").agg(F.collect_list(F.struct("first.pos", "line", "leaf", "n_docs")).alias("asked"))
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("mark"), "text").join(asked, ["d", "mark"])
    split = texts.select(F.split("text", "\n", -1).alias("lines"), "asked").select("lines", F.explode("asked").alias("a"))
    found = split.select("a.line", "a.leaf", masked(F.get("lines", F.col("a.pos"))).alias("masked"), "a.n_docs")
    found = stored(found.where(F.xxhash64("masked") == F.col("line")), "asked").dropDuplicates(["line"])
    parsed = stored(templates(found, share, max_leaf).withColumn("template", F.xxhash64("template")), "templates")
    # templates of several lines: a document that has two of them counts once
    several = stored(parsed.join(parsed.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("template"), "template"), "several")
    pairs = rows.select("d", "line").join(several, "line").select("template", "d").distinct()
    wide = pairs.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("d").alias("first_doc")).where(F.col("n_docs") >= min_docs)
    grown = several.join(wide, "template").select("line", "first_doc", "n_docs")
    alone = counted.where(F.col("n_docs") >= min_docs).select("line", F.col("first.d").alias("first_doc"), "n_docs").join(grown.select("line"), "line", "left_anti")
    return grown.unionByName(alone)


def _recurring_whole(rows: DataFrame) -> DataFrame:
    """(whole, first): the long lines that repeat to the letter in another document; ``first`` has d, mark and total."""
    long = rows.where(F.col("whole").isNotNull())
    firsts = long.groupBy("whole").agg(F.min(F.struct("d", "mark", "total")).alias("first"), F.max("d").alias("last_doc"))
    return firsts.where(F.col("first.d") < F.col("last_doc")).select("whole", "first")


def _long_hits(rows: DataFrame, copy_share: float) -> DataFrame:
    """(d, mark, at): the places of long lines to drop, document by document."""
    found = rows.where(F.col("whole").isNotNull()).join(stored(_recurring_whole(rows), "whole"), "whole").where(F.col("d") != F.col("first.d"))
    shared = found.groupBy("d", "mark", "first").agg(F.collect_set("pos").alias("at"), F.sum("size").alias("common"), F.max("total").alias("total"))
    either = F.col("total") + F.col("first.total") - F.col("common")
    copy = (F.col("mark") == F.col("first.mark")) | (F.col("common") >= copy_share * either)
    return shared.where(~copy).select("d", "mark", "at")


def drop_recurring(
    docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, share: float = SHARE, max_leaf: int = MAX_LEAF, long_tokens: int = LONG_TOKENS, long_chars: int = LONG_CHARS,
    copy_share: float = COPY_SHARE,
) -> DataFrame:
    """``docs`` with its recurring lines dropped, and the columns _n_lines and _n_dropped."""
    carried = Carried(docs, "doc_id", "text")
    docs = carried.df
    rows = stored(line_rows(docs.select("doc_id", "text"), leading, long_tokens, long_chars), "lines")
    found = stored(recurring(docs, rows, min_docs, share, max_leaf), "recurring").groupBy("line").agg(F.min("first_doc").alias("first_doc"))
    short = rows.where(F.col("line").isNotNull()).select("d", "mark", "pos", "line").join(found, "line").where(F.col("d") != F.col("first_doc"))
    hits = short.select("d", "mark", F.array("pos").alias("at")).unionByName(_long_hits(rows, copy_share))
    hits = hits.groupBy("d", "mark").agg(F.flatten(F.collect_list("at")).alias("hits"))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))
    joined = docs.join(hits, (key == hits["d"]) & (F.xxhash64(docs["text"]) == hits["mark"]), "left").drop("d", "mark")
    split = F.split("text", "\n", -1)
    # a hash set of the dropped places, so that a text of many lines takes time in proportion
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "hits")
    kept = F.transform(places, lambda i: F.get(F.col("split"), i))
    hit = F.col("hits").isNotNull() & F.col("text").isNotNull()
    dropped = (
        joined.withColumn("split", F.when(F.col("text").isNotNull(), split))
        .withColumn("n_lines", F.when(F.col("text").isNotNull(), F.size("split")).otherwise(0).cast("long"))
        .withColumn("kept", F.when(hit, kept))
        .withColumn("n_dropped", F.when(hit, F.col("n_lines") - F.size("kept")).otherwise(0).cast("long"))
        .withColumn("text", F.when(hit, F.array_join("kept", "\n")).otherwise(F.col("text")))
    )
    return carried.back(dropped, F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with its recurring lines dropped, columns unchanged; ``n_chars``, where there is one, follows the text."""
    carried = Carried(docs, "doc_id", "text", "n_chars")
    done = drop_recurring(carried.df).select(*carried.inner)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return carried.back(done)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")
