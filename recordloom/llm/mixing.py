"""Mixing sources to target weights, in DataFrame operations only.

Each source's words, in a pseudorandom document order, are packed into blocks of a fixed
number of words (a document may span blocks, a block may hold several documents). Every
output shard has a fixed number of slots; each slot draws its source, so the sources'
counts in a shard are multinomial. A source's slots are numbered through its shards, and
slot k takes block ``perm(k mod n)`` of pass ``k div n``, where each pass has its own
pseudorandom permutation of the source's n block numbers. Slots and blocks then meet in
an equi-join on (source, block).

The multinomial counts of all shards add up to about the targets, not exactly: slots
beyond a source's target are left empty, and the sources that fell short get theirs in
closing shards. The last slot of a source is cut to the words its target still lacks, so
a source takes exactly its target, rounded down to whole words. A target of at most three
times a source's size means at most three whole passes, so no document is taken more than
three times.

Permutations are swap-or-not networks over xxhash64, bijections of [0, n) for any n, and
all numbers come from hashes of (seed, source, position): reruns agree.

Running positions per source are found in two levels (a hashed chunk of the source, then
the chunk sums), so a source with a third of all rows is spread over ``chunks`` keys, of
which there are more the more rows there are. Only the plan, one row per source, is ever
in one task: sources may number in the hundred thousands, not in the billions.

Defined cases: a null or blank text has no words, takes no part and gets ``taken`` 0; a
null source is a source of its own, ordered last; a null doc_id is a document like any
other; repeated rows are separate documents; a very long text spans blocks like any other
and is counted whole; an empty table gives an empty result; only doc_id, text and source
(and the columns named in ``carry``) are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.storage import stored

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
#: Rows of a chunk, about, and the least number of chunks.
CHUNK_ROWS = 20_000
LEAST_CHUNKS = 256
ROUNDS = 24
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the lookup from a draw to its source.
GUIDE = 4096
#: Parts of documents that share id and text which one list holds on average.
PARTS_PER_LIST = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares of all words, capped.

    Raising a common level until the shares add up, with each source stopped at its cap, is
    what resharing the excess by weight ends in. Sources ordered by cap / weight are stopped
    from the front; the level follows from the running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most_times))
    by_stop = Window.orderBy("stop", F.col("source").isNull(), "source")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("stop", F.col("cap") / F.col("weight"))
    t = (
        t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    # the first level that its own source does not stop
    t = t.withColumn("nth_stop", F.row_number().over(by_stop))
    level = F.min_by(F.col("level"), F.when(F.col("level") <= F.col("stop"), F.col("nth_stop"))).over(everything)
    return t.withColumn("final", level).select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap"))).alias("target")
    )


def permuted(k: Column, n: Column, *key: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """Position of ``k`` in a pseudorandom permutation of [0, n): a swap-or-not network."""
    steps = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))

    def step(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        flip = F.xxhash64(*key, r, F.greatest(x, mate)).bitwiseAND(F.lit(1)) == 1
        return F.when(flip, mate).otherwise(x)

    return F.aggregate(steps, k.cast("long"), step)


def _explode_range(df: DataFrame, low: Column, high: Column, name: str, total: int, piece: int = 4096) -> DataFrame:
    """A row for each of the ``total`` whole numbers in [low, high), in two steps, so no task unrolls a hot row alone."""
    parts = df.withColumn("_lo", low.cast("long")).withColumn("_hi", high.cast("long")).where(F.col("_hi") > F.col("_lo"))
    parts = parts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo") - 1) / piece))))
    parts = parts.repartition(max(1, -(-total // (8 * piece))), F.xxhash64("source", "_lo", "_part"))
    start = F.col("_lo") + F.col("_part") * piece
    return parts.withColumn(name, F.explode(F.sequence(start, F.least(start + piece, F.col("_hi")) - 1))).drop("_lo", "_hi", "_part")


class Mix:
    """The mix of ``docs``; its tables are made on first use and kept in scratch storage.

    ``layout``  one row per document with its place among its source's words
    ``plan``    one row per source: sizes, target, passes, slots
    ``slots``   one row per filled slot: shard, source, block, words to take
    ``pieces``  one row per slot and document part: what the slot takes from the document
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most_times=MOST_TIMES, block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED, chunks: int | None = None, carry=()):
        chunks = chunks or max(LEAST_CHUNKS, -(-docs.count() // CHUNK_ROWS))
        self.spark, self.block, self.shard, self.seed, self.carry = docs.sparkSession, block_words, shard_slots, seed, list(carry)
        sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), *self.carry)
        sized = stored(sized.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(chunks))), "sized")
        by_chunk = stored(sized.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size")), "chunks")
        sizes = by_chunk.groupBy("source").agg(F.sum("chunk_size").alias("source_size"))
        self.plan = stored(self._plan(targets(sizes, weights, most_times)), "plan")
        in_source = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        begins = by_chunk.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(in_source), F.lit(0))).select(
            F.col("source").alias("_s"), F.col("chunk").alias("_c"), "chunk_start"
        )
        in_chunk = Window.partitionBy("source", "chunk").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "mark"), "doc_id", "mark")
        placed = (
            sized.withColumn("_before", F.sum("size").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .withColumn("nth", F.row_number().over(in_chunk))
        )
        placed = placed.join(begins, placed.source.eqNullSafe(begins._s) & (placed.chunk == begins._c))
        self.layout = stored(
            placed.select("doc_id", "source", "chunk", "nth", "mark", "size", (F.col("chunk_start") + F.col("_before")).alias("start"), *self.carry), "layout"
        )
        self.slots = stored(self._slots(), "slots")

    def _plan(self, aims: DataFrame) -> DataFrame:
        size, words = F.col("source_size"), F.floor(F.col("target") + 1e-9)
        blocks = F.ceil(size / self.block)
        t = aims.withColumn("words", words).withColumn("blocks", blocks)
        t = t.withColumn("passes", F.when(size > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        t = t.withColumn("rest", F.col("words") - F.col("passes") * size).withColumn("tail", size - (F.col("blocks") - 1) * self.block)
        # where the short last block stands in the pass that is not completed
        tail_at = F.when(F.col("blocks") > 0, permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(self.seed), F.col("source"), F.col("passes"), inverse=True))
        t = t.withColumn("tail_at", tail_at)
        plain = F.ceil(F.col("rest") / self.block)
        lacks = self.block - F.col("tail")
        rest_slots = F.when(F.col("tail_at") < plain, F.ceil((F.col("rest") + lacks) / self.block)).otherwise(plain)
        last_full = F.when(F.col("tail_at") < rest_slots, rest_slots * self.block - lacks).otherwise(rest_slots * self.block)
        t = t.withColumn("rest_slots", rest_slots).withColumn("cut", F.greatest(F.lit(0), last_full - F.col("rest")))
        t = t.withColumn("n_slots", (F.col("passes") * F.col("blocks") + F.col("rest_slots")).cast("long"))
        order = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
        return t.withColumn("slots_to", F.sum("n_slots").over(order)).withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy()))

    def _slots(self) -> DataFrame:
        plan, seed = self.plan, F.lit(self.seed)
        total = plan.agg(F.coalesce(F.max("all_slots"), F.lit(0)).alias("n")).first()["n"]
        plan = plan.where(F.col("n_slots") > 0)
        shards = max(1, -(-total // self.shard))
        cell = max(1, -(-total // GUIDE))
        # draws: uniform in [0, total); the source whose range of running slot counts holds the draw
        draws = (
            self.spark.range(total).select(F.expr(f"id div {self.shard}").alias("shard"), F.pmod(F.xxhash64(seed, F.lit("draw"), "id"), F.lit(max(1, total))).alias("draw"))
            .withColumn("cell", F.expr(f"draw div {cell}"))
        )
        ranges = plan.select("source", (F.col("slots_to") - F.col("n_slots")).alias("lo"), F.col("slots_to").alias("hi"))
        ranges = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
        hit = draws.join(ranges, "cell").where((F.col("draw") >= F.col("lo")) & (F.col("draw") < F.col("hi")))
        counts = hit.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("drawn"))
        upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("k_to", F.sum("drawn").over(upto))
        wide = plan.select(F.col("source").alias("_s"), "n_slots", "blocks", "passes", "tail", "cut")
        main = counts.join(wide, counts.source.eqNullSafe(wide._s)).select(
            "source", "shard", "n_slots", "blocks", "passes", "tail", "cut", (F.col("k_to") - F.col("drawn")).alias("k_from"), F.least("k_to", "n_slots").alias("k_to")
        )
        got = counts.groupBy("source").agg(F.sum("drawn").alias("got")).select(F.col("source").alias("_g"), "got")
        short = plan.join(got, plan.source.eqNullSafe(got._g), "left").select(
            "source", F.lit(None).cast("long").alias("shard"), "n_slots", "blocks", "passes", "tail", "cut", F.coalesce("got", F.lit(0)).alias("k_from"), F.col("n_slots").alias("k_to")
        )
        lacking = short.agg(F.sum(F.greatest(F.lit(0), F.col("k_to") - F.col("k_from"))).alias("n")).first()["n"] or 0
        closing = max(1, -(-lacking // self.shard))
        slots = _explode_range(main.unionByName(short), F.col("k_from"), F.col("k_to"), "k", total)
        turn = F.expr("k div blocks")
        block = permuted(F.expr("k % blocks"), F.col("blocks"), seed, F.col("source"), turn)
        whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(self.block))
        take = F.when(F.col("k") == F.col("n_slots") - 1, whole - F.col("cut")).otherwise(whole)
        late = F.lit(shards) + F.pmod(F.xxhash64(seed, F.lit("closing"), "source", "k"), F.lit(closing))
        return slots.withColumn("block", block).select(F.coalesce("shard", late).alias("shard"), "source", "k", "block", take.cast("long").alias("take"))

    @property
    def pieces(self) -> DataFrame:
        """shard, k, source, block; chunk, nth and doc_id of the document; first word and number of words taken from it."""
        spans = self.layout.where(F.col("size") > 0).withColumn(
            "block", F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")))
        )
        inside = F.greatest(F.lit(0), F.col("start") - F.col("block") * self.block)
        s = self.slots.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "shard", "k", "take")
        from_word = F.greatest(F.lit(0), F.col("block") * self.block - F.col("start"))
        room = F.least(F.col("size") - from_word, F.lit(self.block) - inside, F.col("take") - inside)
        return (
            spans.join(s, spans.source.eqNullSafe(s._s) & (spans.block == s._b)).drop("_s", "_b")
            .withColumn("from_word", from_word).withColumn("words", room).where(F.col("words") > 0)
            .select("shard", "k", "source", "block", "doc_id", "chunk", "nth", "mark", "from_word", "words", *self.carry)
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per document."""
        base = self.layout.select("source", "chunk", "nth", "doc_id", "size", F.lit(0).cast("long").alias("words"))
        more = self.pieces.select("source", "chunk", "nth", "doc_id", F.lit(0).cast("long").alias("size"), F.col("words").cast("long").alias("words"))
        sums = base.unionByName(more).groupBy("source", "chunk", "nth", "doc_id").agg(F.sum("size").alias("size"), F.sum("words").alias("taken"))
        p = self.plan.select(F.col("source").alias("_s"), "source_size", "target")
        return sums.join(p, sums.source.eqNullSafe(p._s)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per slot and document part, with the part's own text.

    Columns doc_id, text, lang, source, n_chars; a document taken twice gives two rows. The
    text keeps the white space between and after its words.
    """
    mix = Mix(docs.select("doc_id", "text", "lang", "source"), carry=("lang",), **options)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    pieces = stored(mix.pieces.select(key, F.col("mark").alias("_mark"), "shard", "k", "nth", "doc_id", "lang", "source", "from_word", "words"), "pieces")
    # rows that repeat one id and text, or have no id, share a key: their parts are dealt into lists of a bounded length
    many = pieces.groupBy("_key", "_mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PARTS_PER_LIST)
    lists = F.coalesce(F.ceil(F.col("n") / PARTS_PER_LIST), F.lit(1).cast("long"))
    dealt = pieces.join(many, ["_key", "_mark"], "left").withColumn("_list", F.pmod(F.xxhash64("shard", "k", "nth", "from_word"), lists))
    parts = dealt.groupBy("_key", "_mark", "_list").agg(F.collect_list(F.struct("doc_id", "lang", "source", "from_word", "words")).alias("parts"))
    texts = docs.select(key, F.xxhash64("text").alias("_mark"), "text").dropDuplicates(["_key", "_mark"])
    words = F.regexp_extract_all("text", F.lit(r"(?:^[\x20\x09-\x0D]+)?" + WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # words are cut once per document; each part takes its slice of them
    taken = texts.join(parts, ["_key", "_mark"]).select(words.alias("all_words"), "parts").select("all_words", F.explode("parts").alias("p"))
    text = F.array_join(F.slice("all_words", (F.col("p.from_word") + 1).cast("int"), F.col("p.words").cast("int")), "")
    return taken.select("p.doc_id", text.alias("text"), "p.lang", "p.source").withColumn("n_chars", F.length("text").cast("long"))


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all of ``documents``."""
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
