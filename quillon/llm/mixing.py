"""Records of several sources mixed so that each has its share of all tokens.

Method: the tokens of each source are summed, its repetition rate is derived, and each document is
used floor(rate) times, and once more with a probability of the fraction, drawn from a hash of seed
and doc_id. The size of the mix, unless given, is the largest at which every source that has documents
can give its share without any document being used more than its max_repeats times.

With a given size a source may be unable to give its share: then its rate stops at max_repeats, and
the shares reached are reported. Shares of sources without documents go to the others in proportion;
`target_share` is reported as given.

Defined results: a null source and sources without a target are left out of the mix (rate 0, reported
with a null target); null or empty texts have 0 tokens and are used at their source's rate; repeated
rows draw alike; no documents, no rows. Targets are a small table (at most `max_sources` rows, checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(sized: DataFrame, targets: DataFrame, mix_tokens: float | None = None, max_sources: int = 100_000) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, rate): one row per target or source."""
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.col("max_repeats"), F.lit(0)).cast("int").alias("max_repeats")).where(F.col("source").isNotNull())
    if t.limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    have = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    both = have.join(F.broadcast(t), "source", "full_outer").select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    all_ = both.where(usable).agg(F.sum("target_share").alias("shares"), F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")).alias("size"))
    whole = (F.lit(float(mix_tokens)) / F.col("shares")) if mix_tokens is not None else F.col("size")
    rate = F.least(F.col("target_share") * whole / F.col("n_tokens"), F.col("max_repeats").cast("double"))
    return both.crossJoin(F.broadcast(all_)).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", F.when(usable, rate).otherwise(0.0).alias("rate"))


def mixed(sized: DataFrame, rate: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): the documents of the mix."""
    # a source a row: the number of rows was checked for the targets; other sources have rate 0 and aren't sent
    used = rate.where("rate > 0").select("source", "rate")
    draw = (F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    # a rate that is whole but for rounding stays whole
    r = F.round("rate", 12)
    n = (F.floor(r) + (draw < r - F.floor(r)).cast("long")).cast("int")
    return sized.join(F.broadcast(used), "source").select("doc_id", "source", "n_tokens", n.alias("repeats")).where("repeats > 0")


def shares(mix: DataFrame, rate: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, rate, n_docs, used_docs, most_repeats, used_tokens, share): targets against what was reached."""
    got = mix.groupBy("source").agg(F.count("*").alias("used_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    total = got.agg(F.sum("used_tokens").alias("_all"))
    out = rate.join(got, "source", "left").crossJoin(F.broadcast(total))
    used = F.coalesce("used_tokens", F.lit(0))
    return out.select(
        "source", "target_share", "max_repeats", "rate", "n_docs", F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        used.alias("used_tokens"), F.coalesce(F.try_divide(used, F.col("_all")), F.lit(0.0)).alias("share"),
    )
