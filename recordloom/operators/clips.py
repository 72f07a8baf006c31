"""Passages of broadcasts and posts matched to records, and runs of passages made into clips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.assignment import near_stories
from recordloom.storage import stored

#: Nearest records asked, the band under the best of them, stories in the band
#: from which on a passage is about none, hours around a passage, the share of records in
#: which a name says nothing, headline words that place a passage, seconds and number of clips.
CANDIDATES = 8
TOP_BAND = 0.03
MAGNET_STORIES = 6
HOURS = 72
COMMON_SHARE = 0.01
TITLE_WORDS = 2
CLIP_SECONDS = 90.0
CLIPS = 4
PREVIEW_HOURS = 24
#: Fixed value: headline words that place nothing.
STOP = (
    "the and for with from that this over after into amid says said will have has "
    "india indian government govt news live updates update brief evening morning today"
).split()
#: Fixed value: how a headline tells of what is still to come.
PREVIEW = (
    r"(?i)\b(to (inaugurate|launch|open|begin|start|hold|host|meet|visit|address|unveil|announce|table|present|kick off)"
    r"|set to|set for|ahead of|likely to|expected to|due to (open|begin|start)"
    r"|will (inaugurate|launch|open|begin|start|hold|host|meet|visit|address|unveil|announce))\b"
    r"|\bon (monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\btomorrow\b|\bnext week\b"
)
_MICROS = 3_600_000_000


def _spaced(text: Column) -> Column:
    """Words with single spaces around each, so that whole words are found as substrings."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_]+", " ")), F.lit(" "))


def names_it(text: Column, name: Column) -> Column:
    """Whether a text has a name as whole words; one of three letters as it is written, shorter ones never."""
    long = F.contains(_spaced(F.lower(text)), _spaced(F.lower(name)))
    return F.when(F.length(F.trim(name)) < 3, F.lit(False)).when(F.length(F.trim(name)) == 3, F.contains(_spaced(text), _spaced(name))).otherwise(long)


def title_hits(text: Column, title: Column) -> Column:
    """How many content words of a title a text has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z][a-z0-9']{3,}"), F.lit(0)))
    content = F.filter(words, lambda w: ~w.isin(*STOP))
    return F.size(F.array_intersect(content, F.split(F.trim(_spaced(F.lower(text))), " ")))


def placed(
    passages: DataFrame, records: DataFrame, addresses: DataFrame, cast: DataFrame, stories: DataFrame, judge: Callable[[DataFrame], DataFrame],
    min_cos: float, magnet: int = MAGNET_STORIES, common: float = COMMON_SHARE,
) -> DataFrame:
    """(passage_id, event_id, story, score, method): the records that a passage is about, one of each story.

    ``passages`` has (passage_id, at, text, vector, urls), ``records`` (event_id, title, at,
    vector), ``addresses`` (event_id, url) of reports, ``cast`` (event_id, name), ``stories``
    (event_id, story); a record without a story is one by itself. An address in common
    decides at once (method ``url``, score 1). Otherwise the nearest records of 72 hours
    around count that are within a band of the best and no preview gone by; a passage near
    too many stories is about none; and it has to name a rare member of the cast or two
    words of the title, and the judge, who adds ``ok``, has to agree.
    """
    of = stories.select("event_id", "story")
    story = F.coalesce("story", "event_id")
    links = passages.select("passage_id", F.explode("urls").alias("url")).join(addresses.select("event_id", "url").distinct(), "url").select("passage_id", "event_id").distinct()
    links = stored(links, "links")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asks = passages.select(F.col("passage_id").alias("event_id"), micros("at").alias("at"), "vector")
    held = records.select(F.col("event_id").alias("story"), micros("at").alias("at"), "vector")
    near = near_stories(asks, held, CANDIDATES, 1 - min_cos, HOURS * _MICROS, before=HOURS * _MICROS).select(F.col("event_id").alias("passage_id"), F.col("story").alias("event_id"), F.round(1 - F.col("d"), 6).alias("score"))
    near = near.join(links, ["passage_id", "event_id"], "left_anti")
    titled = near.join(records.select("event_id", "title", micros("at").alias("seen")), "event_id").join(passages.select("passage_id", "text", micros("at").alias("aired")), "passage_id")
    gone = F.col("title").rlike(PREVIEW) & (F.col("aired") - F.col("seen") > PREVIEW_HOURS * _MICROS)
    own = Window.partitionBy("passage_id")
    band = titled.where(~gone).withColumn("best", F.max("score").over(own)).where(F.col("score") >= F.col("best") - TOP_BAND - 1e-9)
    band = band.join(of, "event_id", "left").withColumn("story", story).withColumn("n", F.size(F.collect_set("story").over(own))).where(F.col("n") <= magnet)
    band = stored(band.select("passage_id", "event_id", "story", "score", "text", "title"), "band")
    n = records.agg(F.count(F.lit(1))).scalar()
    often = cast.select("name", "event_id").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > n * common).select("name")
    rare = cast.select("event_id", "name").distinct().join(often, "name", "left_anti")
    named = band.join(rare, "event_id").where(names_it(F.col("text"), F.col("name"))).select("passage_id", "event_id").distinct()
    worded = band.where(title_hits(F.col("text"), F.col("title")) >= TITLE_WORDS).select("passage_id", "event_id")
    asked = band.join(named.unionByName(worded).distinct(), ["passage_id", "event_id"], "left_semi").select("passage_id", "event_id", "story", "score")
    agreed = judge(asked).where("ok").select("passage_id", "event_id", "story", "score", F.lit("judge").alias("method"))
    sure = links.join(of, "event_id", "left").select("passage_id", "event_id", story.alias("story"), F.lit(1.0).alias("score"), F.lit("url").alias("method"))
    nth = F.row_number().over(Window.partitionBy("passage_id", "story").orderBy(F.desc("score"), "event_id"))
    return agreed.unionByName(sure).withColumn("nth", nth).where(F.col("nth") == 1).select("passage_id", "event_id", "story", "score", "method")


def grown(passages: Column, seconds: float = CLIP_SECONDS) -> Column:
    """struct(lo, hi): the places of a run's best passage and as many neighbours as fit in ``seconds``.

    ``passages`` is the run in order, of structs with start_s, end_s and score. One passage
    before and one after are tried in turn until neither fits.
    """
    at = lambda i: F.get(passages, i)
    scores = F.transform(passages, lambda p: p["score"])
    best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

    def step(s: Column, _: Column) -> Column:
        before = (s["lo"] > 0) & (at(s["hi"])["end_s"] - at(s["lo"] - 1)["start_s"] <= seconds)
        lo = F.when(before, s["lo"] - 1).otherwise(s["lo"])
        after = (s["hi"] < F.size(passages) - 1) & (at(s["hi"] + 1)["end_s"] - at(lo)["start_s"] <= seconds)
        return F.struct(lo.alias("lo"), F.when(after, s["hi"] + 1).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(passages, F.struct(best.alias("lo"), best.alias("hi")), step)


def clips(hits: DataFrame, seconds: float = CLIP_SECONDS, most: int = CLIPS) -> DataFrame:
    """(event_id, episode, seq, start_s, end_s, score, rnk): each record's best clips, one of each episode.

    ``hits`` has (event_id, episode, seq, start_s, end_s, score): passages of an episode in
    order. Passages in a row are one clip, grown from the best of them; ``seq`` is that one's.
    """
    run = F.col("seq") - F.row_number().over(Window.partitionBy("event_id", "episode").orderBy("seq"))
    rows = hits.withColumn("run", run).groupBy("event_id", "episode", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "start_s", "end_s", "score"))).alias("p"))
    ends = rows.withColumn("g", grown(F.col("p"), seconds)).withColumn("top", F.array_max(F.transform("p", lambda x: F.struct(x["score"].alias("score"), (-x["seq"]).alias("first")))))
    made = ends.select("event_id", "episode", (-F.col("top.first")).alias("seq"), F.get("p", F.col("g.lo"))["start_s"].alias("start_s"), F.get("p", F.col("g.hi"))["end_s"].alias("end_s"), F.col("top.score").alias("score"))
    order = [F.desc("score"), F.asc("seq")]
    one = made.withColumn("n", F.row_number().over(Window.partitionBy("event_id", "episode").orderBy(*order))).where(F.col("n") == 1).drop("n")
    rnk = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), "episode", "seq"))
    return one.withColumn("rnk", rnk).where(F.col("rnk") <= most)
