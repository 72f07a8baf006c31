"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that
speaker as the assistant and everybody else as a named user, with a mask of the
characters that the model is to learn: the assistant's own words and the end mark of its
turns. A rendered turn is

    <|assistant|>\\nTEXT<|end|>\\n          (the speaker whose perspective it is)
    <|user name=NAME|>\\nTEXT<|end|>\\n     (anyone else)

``system`` turns are nobody's perspective; they open as ``<|system|>`` in every rendering.
Names and texts are escaped (``<|`` becomes ``<\\u200b|`` and, in names, ``|>`` becomes
``|\\u200b>``), so they can't forge a mark. Renderings grow with a conversation's turns
times its participants, as the method has it.

A rendering is a row per part of ``part_turns`` turn numbers, and of each ``MOST_ROWS`` rows
where turn numbers repeat or are missing, so a conversation of
any length is never gathered into one row. Participants are found by a grouped set
(combined map-side); only the dialogue's own rows meet the participant list.

Defined cases: a null text is an empty turn; a null role is a participant named
``unknown``; a null conv_id is a conversation of its own; a null turn comes first, in the
first part; turns of equal number are ordered by role, then text, and repeated rows are
all rendered; a conversation of system turns alone has no rendering; an empty table gives
an empty result; only the four columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM = "system"
UNKNOWN = "unknown"
MOST_ROWS = 4096


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, most_rows: int = MOST_ROWS) -> DataFrame:
    """conv_id, perspective, part, piece, n_turns, n_own, text, mask, n_masked.

    ``piece`` is 0 but in parts of over ``most_rows`` rows.
    ``mask`` lists start:end character ranges of the part's text, comma-joined.
    """
    fenced = lambda c: F.replace(c, F.lit("<|"), F.lit("<​|"))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"), fenced(F.coalesce("text", F.lit(""))).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long"))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    # one row for a part of a conversation, whoever's perspective it takes
    line = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text")
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("piece", F.floor((nth - 1) / most_rows).cast("long"))
    parts = rows.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    seen = parts.join(speakers, parts.conv_id.eqNullSafe(speakers._c)).drop("_c")
    own = lambda x: x["role"] == F.col("perspective")
    opening = lambda x: (
        F.when(own(x), F.lit("<|assistant|>\n")).when(x["role"] == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.replace(fenced(x["role"]), F.lit("|>"), F.lit("|​>")), F.lit("|>\n")))
    )
    piece = lambda x: F.struct(
        opening(x).alias("open"), F.concat(x["text"], F.lit("<|end|>")).alias("body"), own(x).alias("own")
    )
    done = seen.withColumn("pieces", F.transform("lines", piece))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["body"], F.lit("\n"))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n"))

    def walk(acc, p):
        begin = acc["at"] + F.length(p["open"])
        end = begin + F.length(p["body"])
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(
            (end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            F.when(p["own"], acc["n"] + end - begin).otherwise(acc["n"]).cast("long").alias("n"),
        )

    done = done.withColumn("marks", F.aggregate("pieces", start, walk))
    return done.select(
        "conv_id", "perspective", "part", "piece", F.size("lines").cast("long").alias("n_turns"),
        F.size(F.filter("lines", own)).cast("long").alias("n_own"), text.alias("text"),
        F.array_join("marks.spans", ",").alias("mask"), F.col("marks.n").alias("n_masked"),
    )


def op5_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every perspective of all of ``conversations``."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH rows AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1) // 4096 AS piece
  FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS text,
               coalesce(CAST(floor(turn / 256.0) AS BIGINT), 0) AS part FROM conversations)
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM rows WHERE role <> 'system'
), pieces AS (
  SELECT r.conv_id, s.perspective, r.part, r.piece, r.turn, r.role, r.text, r.role = s.perspective AS own,
         CASE WHEN r.role = s.perspective THEN '<|assistant|>' || chr(10) WHEN r.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(replace(r.role, '<|', '<' || chr(8203) || '|'), '|>', '|' || chr(8203) || '>') || '|>' || chr(10) END AS opening,
         r.text || '<|end|>' AS body
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS n,
         coalesce(sum(length(opening) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, role, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM pieces WINDOW w AS (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, perspective, part, piece, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(opening || body || chr(10), '' ORDER BY n) AS text,
       coalesce(string_agg(CAST(CAST(pos + length(opening) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(opening) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (own), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part, piece
"""
