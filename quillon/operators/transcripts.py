"""Captions and voices: cues of caption files, places of quotes, the dominant voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T


def caption_cues(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, t, line): new caption lines (those with timing tags), tags stripped, repeats of the line before dropped."""
    raw = files.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r", -1)).alias("pos", "raw"))
    head = r"^(\d\d):(\d\d):(\d\d)\.\d+\s+-->"
    h, m, s = (F.regexp_extract("raw", head, i) for i in (1, 2, 3))
    at = F.when(h != "", h.cast("int") * 3600 + m.cast("int") * 60 + s.cast("int"))
    order = W.partitionBy(key).orderBy("pos")
    timed = raw.withColumn("own", at).withColumn("t", F.last("own", ignorenulls=True).over(order))
    new = timed.where(F.col("own").isNull() & F.col("t").isNotNull() & F.contains("raw", F.lit("<"))).withColumn("line", T.strip(F.regexp_replace("raw", "<[^>]+>", ""))).where("line <> ''")
    return new.withColumn("before", F.lag("line").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("line"))).select(key, "pos", "t", "line")


def flat(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda c: c["line"]), " ")


def locate(cues: Column, quote: Column) -> Column:
    """Second of the first cue that the quote begins in; null where it doesn't stand in the joined lines."""
    at = F.instr(flat(cues), T.strip(quote)) - 1
    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast("int").alias("t"), F.lit(False).alias("hit"))

    def step(acc: Column, cue: Column) -> Column:
        end = acc["end"] + F.length(cue["line"]) + 1
        now = ~acc["hit"] & (end > at)
        return F.struct(end.alias("end"), F.when(now, cue["t"]).otherwise(acc["t"]).alias("t"), (acc["hit"] | now).alias("hit"))

    return F.when((F.size(cues) > 0) & (at >= 0), F.aggregate(cues, start, step)["t"])


def segments(turns: DataFrame, longest_s: float = 28.0) -> DataFrame:
    """(video_id, turn_no, part, start_s, end_s): turns cut into stretches of at most `longest_s` seconds; empty turns have none."""
    n = F.ceil((F.col("end_s") - F.col("start_s")) / F.lit(longest_s)).cast("int")
    parts = turns.where(F.col("end_s") > F.col("start_s")).withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("start_s") + F.col("part") * F.lit(longest_s)
    return parts.select("video_id", "turn_no", "part", start.alias("start_s"), F.least(start + F.lit(longest_s), F.col("end_s")).alias("end_s"))


def dominant_voices(turns: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(video_id, voice, share): the voice with more than `least_share` of the spoken seconds; even debates have none."""
    per = turns.groupBy("video_id", "voice").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    top = per.groupBy("video_id").agg(F.sum("seconds").alias("all"), F.max(F.struct("seconds", "voice")).alias("x"))
    share = F.try_divide(F.col("x.seconds"), F.col("all"))
    return top.select("video_id", F.col("x.voice").alias("voice"), share.alias("share")).where(F.col("share") > least_share)


def voice_texts(turns: DataFrame, voices: DataFrame) -> DataFrame:
    """(video_id, voice, n_turns, text): the words of the chosen voice in order."""
    own = turns.join(voices.select("video_id", "voice"), ["video_id", "voice"])
    said = F.array_sort(F.collect_list(F.struct("start_s", "turn_no", "text")))
    g = own.groupBy("video_id", "voice").agg(said.alias("said"))
    return g.select("video_id", "voice", F.size("said").alias("n_turns"), F.array_join(F.transform("said", lambda x: x["text"]), " ").alias("text"))


def sample_turns(turns: DataFrame, shares: tuple[float, ...] = (0.2, 0.5, 0.8)) -> DataFrame:
    """(video_id, voice, share, turn_no): the turns at these positions of each voice's turns."""
    order = W.partitionBy("video_id", "voice").orderBy("start_s", "turn_no")
    n = F.count("*").over(W.partitionBy("video_id", "voice"))
    t = turns.withColumn("rn", F.row_number().over(order)).withColumn("n", n)
    at = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    return t.select("video_id", "voice", "turn_no", "rn", "n", at).where(F.col("rn") == F.floor(F.col("n") * F.col("share")) + 1).select("video_id", "voice", "share", "turn_no")
