"""Positions of people on axes: evidence cells, reliability, grid, feed, scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T


def evidence(claims: DataFrame) -> DataFrame:
    """(person, axis, claim_id, source_url): the distinct evidence of each cell, one row each, however large a cell is."""
    return claims.select("person", "axis", "claim_id", "source_url").distinct()


def cells(claims: DataFrame) -> DataFrame:
    """(person, axis, n_claims, n_sources, first_id, last_id) of each cell that has any evidence."""
    return claims.groupBy("person", "axis").agg(
        F.countDistinct("claim_id").alias("n_claims"), F.countDistinct("source_url").alias("n_sources"), F.min("claim_id").alias("first_id"), F.max("claim_id").alias("last_id")
    )


def reliability(claims: DataFrame, capture: str = T.CAPTURE) -> DataFrame:
    """(person, axis, reliability, caveats): the weakest evidence governs."""
    a = claims.groupBy("person", "axis").agg(
        F.countDistinct("source_url").alias("sources"), F.bool_or(F.col("claim_date").isNull()).alias("undated"), F.bool_or(~T.is_capture(F.col("archive_url"), capture)).alias("uncaptured"),
        F.bool_or(F.coalesce(F.col("tier") != "1", F.lit(True))).alias("others"), F.bool_or(~F.coalesce("tier_confirmed", F.lit(False))).alias("unconfirmed"),
    )
    thin = [F.when(F.col("sources") < 2, "single source"), F.when(F.col("undated"), "undated quote"), F.when(F.col("uncaptured"), "no usable capture")]
    soft = [F.when(F.col("others"), "not the person's own words"), F.when(F.col("unconfirmed"), "tier unconfirmed")]
    some = F.filter(F.array(*thin), lambda x: x.isNotNull())
    caveats = F.filter(F.array(*thin, *soft), lambda x: x.isNotNull())
    level = F.when(F.size(some) > 0, "thin").when(F.size(caveats) > 0, "sourced").otherwise("attested")
    return a.select("person", "axis", level.alias("reliability"), caveats.alias("caveats"))


def trace(proof: DataFrame, claims: DataFrame) -> DataFrame:
    """(person, axis, n_found, n_missing): evidence ids that still stand and those that dangle."""
    ids = proof.select("person", "axis", "claim_id").distinct()
    there = claims.select("claim_id").distinct().withColumn("there", F.lit(1))
    j = ids.join(there, "claim_id", "left")
    return j.groupBy("person", "axis").agg(F.count("there").alias("n_found"), F.count_if(F.col("there").isNull()).alias("n_missing"))


def grid(claims: DataFrame, people: DataFrame, axes: list[str]) -> DataFrame:
    """Every person on every axis, with the latest claim or none. An undated claim sorts after dated ones; ties go to the last row."""
    spark = people.sparkSession
    every = people.select(F.col("slug").alias("person")).distinct().crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in axes], "axis string")))
    last = claims.groupBy("person", "axis").agg(F.max_by("claim_id", F.struct(F.coalesce(F.col("claim_date").cast("string"), F.lit("None")), "claim_no")).alias("claim_id"))
    return every.join(last, ["person", "axis"], "left")


def monitored(people: DataFrame) -> DataFrame:
    """(person, monitored): whether any source is enabled (a source is, unless it says no)."""
    on = F.exists("sources", lambda s: F.coalesce(s["enabled"], F.lit(True)))
    return people.select(F.col("slug").alias("person"), F.coalesce(on, F.lit(False)).alias("monitored"))


def cell_states(cells_: DataFrame, watched: DataFrame) -> DataFrame:
    state = F.when(~F.coalesce("monitored", F.lit(False)), "unmonitored").when(F.col("claim_id").isNotNull(), "claim").otherwise("none")
    return cells_.join(watched, "person", "left").select("person", "axis", state.alias("state"))


def feed(claims: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first (undated ones before all); a report of the top `n` where given."""
    rows = claims.orderBy(F.desc(F.coalesce(F.col("claim_date").cast("string"), F.lit("None"))), F.desc("claim_id"), F.desc("claim_no"))
    return rows.limit(n) if n else rows


def same_quote(a: Column, b: Column) -> Column:
    """Whether one normal form holds the other; an empty one is like none."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def scorecard(gold: DataFrame, predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of how predictions reproduce labelled quotes.

    gold: (url_hash, axis, quote), quote null for a document labelled empty; predicted: (url_hash, pos,
    axis, quote), quote null for an empty answer, no row for a failed one; docs: (url_hash, text).
    Quotes are normalized once, then compared within a document only.
    """
    d = docs.groupBy("url_hash").agg(F.max("text").alias("text"))
    # normal forms are materialized as columns here, so the joins below compare plain strings
    g = gold.join(d.select("url_hash"), "url_hash", "left_semi").withColumn("q", T.reader_form(F.col("quote")))
    p = predicted.withColumn("p", T.reader_form(F.col("quote"))).withColumn("exact", T.layout_free(F.col("quote")))
    p = p.select("url_hash", "pos", F.col("axis").alias("p_axis"), "p", "exact")
    answered = p.select("url_hash").distinct().withColumn("answered", F.lit(True))
    per_doc = g.groupBy("url_hash").agg(F.count("quote").alias("n_gold")).join(answered, "url_hash", "left")
    said = p.where(F.col("p").isNotNull()).groupBy("url_hash").agg(F.count("*").alias("n_said"))
    per_doc = per_doc.join(said, "url_hash", "left")
    body = d.join(per_doc.select("url_hash"), "url_hash", "left_semi").select("url_hash", T.layout_free(F.col("text")).alias("body"))
    verbatim = p.where(F.col("p").isNotNull()).join(body, "url_hash").agg(F.count("*").alias("quotes"), F.count_if(F.contains("body", "exact")).alias("verbatim"))
    one = g.where(F.col("q").isNotNull()).withColumn("gid", F.struct("url_hash", "axis", "q"))
    match = one.join(p, "url_hash").where(same_quote(F.col("p"), F.col("q"))).groupBy("gid").agg(F.min_by("p_axis", "pos").alias("p_axis"))
    found = match.agg(F.count("*").alias("found"), F.count_if(F.col("gid.axis") == F.col("p_axis")).alias("agreed"))
    none = F.col("n_gold") == 0
    sums = per_doc.agg(
        F.count("*").alias("documents"), F.count_if(none).alias("expected_empty"), F.count_if(F.col("answered").isNull()).alias("failures"),
        F.count_if(none & F.col("answered").isNotNull() & F.col("n_said").isNull()).alias("kept_empty"), F.coalesce(F.sum("n_gold"), F.lit(0)).alias("gold_quotes"),
    )
    all_ = sums.crossJoin(verbatim).crossJoin(found)
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return all_.select("*", ratio("kept_empty", "expected_empty").alias("discipline"), ratio("verbatim", "quotes").alias("fidelity"), ratio("found", "gold_quotes").alias("recall"), ratio("agreed", "found").alias("axis_agreement"))
