"""Mechanical gates over claims; each gives findings (gate, claim_no, message, fatal)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.skew import bundles

PROSE = ["position_fr", "position_en", "contexte_fr", "contexte_en"]


def _finding(rows: DataFrame, gate: str, message: F.Column, fatal: F.Column | bool = True) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), "claim_no", message.alias("message"), (F.lit(fatal) if isinstance(fatal, bool) else fatal).alias("fatal"))


def quote_hits(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim_no, hit): whether any version of the cited address holds the quote; null where there is none.

    The quotes of an address go to its texts in bundles, so a text is moved and normalized once a bundle, not once a claim.
    """
    quotes = claims.select("claim_no", F.col("source_url").alias("url"), T.layout_free(F.col("quote_fr")).alias("quote"))
    met = docs.select("url", "text").join(bundles(quotes, ["url"], ["claim_no", "quote"]), "url").select(T.layout_free(F.col("text")).alias("body"), "items")
    each = met.select("body", F.explode("items").alias("x")).select("x.claim_no", F.contains("body", "x.quote").alias("hit"))
    hits = each.groupBy("claim_no").agg(F.max("hit").alias("hit"))
    return claims.select("claim_no").distinct().join(hits, "claim_no", "left")


def provenance_and_quote(claims: DataFrame, docs: DataFrame) -> DataFrame:
    hits = quote_hits(claims, docs)
    none = _finding(hits.where(F.col("hit").isNull()), "provenance", F.lit("no stored version of the source"))
    return none.unionByName(_finding(hits.where(~F.col("hit")), "quote", F.lit("the quote does not stand in the source")))


def neutrality(claims: DataFrame, words: list[str] = T.JUDGEMENTS) -> DataFrame:
    """One finding per judgement word in the prose fields, never in the quote."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in PROSE])
    rows = claims.select("claim_no", F.explode(fields).alias("x")).select("claim_no", "x.*")
    hits = rows.select("claim_no", "field", F.explode(F.regexp_extract_all(F.col("text"), F.lit(T.any_of(words)), F.lit(1))).alias("word"))
    return _finding(hits, "neutrality", F.concat_ws(": ", "field", F.lower("word")))


def archive(claims: DataFrame, capture: str = T.CAPTURE) -> DataFrame:
    missing = F.coalesce(F.col("archive_url"), F.lit("")) == ""
    rows = claims.where(~T.is_capture(F.col("archive_url"), capture))
    return _finding(rows, "archive", F.when(missing, "no capture").otherwise(F.concat(F.lit("not a capture: "), F.col("archive_url"))))


def dead_links(claims: DataFrame, alive: DataFrame, capture: str = T.CAPTURE) -> DataFrame:
    """Sources that no longer answer; fatal where no capture stands behind them. alive: (url)."""
    dead = claims.join(alive.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_anti")
    good = T.is_capture(F.col("archive_url"), capture)
    return _finding(dead, "link-rot", F.concat(F.lit("no answer: "), F.col("source_url")), ~good)


def all_gates(claims: DataFrame, docs: DataFrame, capture: str = T.CAPTURE) -> DataFrame:
    """The findings of the gates that need no network; equal findings stay apart."""
    return reduce(DataFrame.unionByName, [provenance_and_quote(claims, docs), neutrality(claims), archive(claims, capture)])


def verdict(findings: DataFrame) -> DataFrame:
    n, fatal = F.count("*"), F.count_if("fatal")
    return findings.agg(fatal.alias("fatal"), (n - fatal).alias("warnings"), (fatal > 0).alias("blocked"))
