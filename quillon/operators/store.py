"""Keyed storage: versions, first sightings, run logs, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, all columns. An aggregate, so a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return top.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, all columns."""
    others = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return top.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen before."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def merge(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The stored rows win; of new ones with an unknown key the first is added."""
    return existing.unionByName(earliest(unseen(new, existing, [key]), [key], order))


def source_rollup(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_id").agg(F.count("*").alias("n_runs"), F.sum("fetched").alias("fetched"), F.sum("kept").alias("kept"), F.max("run_at").alias("last_run"))


def silent_sources(runs: DataFrame, consecutive: int = 3) -> DataFrame:
    """Sources whose last `consecutive` runs exist and all fetched nothing. Rows stored twice count once.

    The last runs of a source are kept in an aggregate, not sorted in one task: per source and slice of
    sequence numbers first, then over the slices' few rows.
    """
    once = runs.groupBy("source_id", "seq").agg(F.max("fetched").alias("fetched"))
    parts = F.pmod(F.xxhash64("seq"), F.lit(64))
    last = W.partitionBy("source_id", "_part").orderBy(F.desc("seq"))
    few = once.withColumn("_part", parts).withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= consecutive)
    top = few.withColumn("_n", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("seq")))).where(F.col("_n") <= consecutive)
    return top.groupBy("source_id").agg(F.count("*").alias("n"), F.max("fetched").alias("most")).where((F.col("n") >= consecutive) & (F.col("most") == 0)).select("source_id")


def run_report(runs: DataFrame, dead: DataFrame) -> DataFrame:
    """Fetched and kept of each source, whether it returned nothing, whether it is silent."""
    sums = runs.groupBy("source_id").agg(F.sum("fetched").alias("fetched"), F.sum("kept").alias("kept"))
    return sums.join(dead.withColumn("silent", F.lit(True)), "source_id", "left").select("source_id", "fetched", "kept", (F.col("fetched") == 0).alias("empty"), F.coalesce("silent", F.lit(False)).alias("silent"))


def export_order() -> list[Column]:
    """Undated claims first."""
    return [F.col("person"), F.coalesce(F.col("claim_date").cast("string"), F.lit("")), F.col("claim_id")]
