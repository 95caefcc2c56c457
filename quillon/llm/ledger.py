"""Copies hidden by spelling: one record each, with its number of copies, kept up batch by batch.

Method: an incremental ledger, stored in a shared folder bucket by bucket. Each batch is aggregated to canonical
keys, the keys are spread over `buckets`, and only the buckets that the batch touches are read and
full-outer-joined with it: counts are added and the earliest representative (the smallest number) is kept.
A touched bucket is written anew beside the old one, an untouched one stays as it is; an append to
the manifest (bucket, batch, place) makes the batch valid at once, so a batch that failed is simply
applied again, and a batch that is delivered twice changes nothing.

The canonical key keeps letters and digits of each field in lower case (accents count). Defined
results: null fields are fields of their own value (two records with null in one field agree in it);
an empty field differs from a null one; repeated rows of one number count once; an empty batch
changes nothing; other columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut, shared_dir
from quillon.skew import join_counted

BUCKETS = 64
LEDGER = "bucket int, key string, first_no long, copies long"


def canonical(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def canonical_key(*fields: Column) -> Column:
    """One key for the fields; null and empty stay apart, and fields cannot run into each other."""
    parts = [F.coalesce(F.concat(F.lit("="), canonical(f)), F.lit("0")) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def keyed(rows: DataFrame, number: str, fields: list[str]) -> DataFrame:
    """(no, key) of the rows."""
    return rows.select(F.col(number).alias("no"), canonical_key(*[F.col(f) for f in fields]).alias("key"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def batch_counts(keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The batch as a ledger of its own; rows are combined before the shuffle."""
    once = keys.where(F.col("no").isNotNull()).groupBy("key", "no").agg(F.lit(1).alias("one"))
    out = once.groupBy("key").agg(F.min("no").alias("first_no"), F.sum("one").cast("long").alias("copies"))
    return out.select(_bucket(buckets).alias("bucket"), "key", "first_no", "copies")


def update(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The touched buckets of the ledger after one more batch (both in the form of `batch_counts`)."""
    a, b = ledger.alias("a"), batch.alias("b")
    return a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") == F.col("b.key")), "full_outer").select(
        F.coalesce("a.bucket", "b.bucket").alias("bucket"),
        F.coalesce("a.key", "b.key").alias("key"),
        F.least("a.first_no", "b.first_no").alias("first_no"),
        (F.coalesce("a.copies", F.lit(0)) + F.coalesce("b.copies", F.lit(0))).cast("long").alias("copies"),
    )


MANIFEST = "seq long, batch string, bucket int, place string"


class Ledger:
    """A ledger in a folder that all executors share; one writer at a time.

    Batches must be disjoint in `no`: the same number in two batches counts twice. The number of buckets is
    fixed with the first batch.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        # with a schema a folder without rows can be read as well
        spark.createDataFrame([], MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def applied(self, batch: str) -> bool:
        return not self._manifest().where(F.col("batch") == batch).isEmpty()

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """(bucket, key, first_no, copies) of all buckets or of `only` these; at most one place a bucket comes to the driver."""
        now = self._manifest().where(F.col("place") != "").groupBy("bucket").agg(F.max_by("place", "seq").alias("place")).collect()
        places = sorted(r["place"] for r in now if only is None or r["bucket"] in only)
        if not places:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema("key string, first_no long, copies long").parquet(*places).select(_bucket(self.buckets).alias("bucket"), "key", "first_no", "copies")

    def apply(self, batch: str, keys: DataFrame) -> bool:
        """Take in a batch of (no, key); False if it was taken in before."""
        if self.applied(batch):
            return False
        new = cut(batch_counts(keys, self.buckets))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        at = f"{self.root}/data/{batch}"
        if touched:
            update(self.rows(touched), new).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        seq = (self._manifest().agg(F.max("seq")).first()[0] or 0) + 1
        entries = [(seq, batch, b, f"{at}/bucket={b}") for b in touched] or [(seq, batch, -1, "")]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return True


def build(spark: SparkSession, batches: list[DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """The rows of a new ledger in the shared folder after these batches of (no, key), disjoint in `no`."""
    out = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", buckets)
    for k, batch in enumerate(batches):
        out.apply(f"batch-{k:06d}", batch)
    return out.rows()


def copies(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """(first_no, copy_no): each further record beside the representative of its set."""
    sets = ledger.where(F.col("copies") > 1).select("key", "first_no", "copies")
    out = join_counted(keys.where(F.col("no").isNotNull()), sets, ["key"], "copies").where(F.col("no") != F.col("first_no"))
    return out.select("first_no", F.col("no").alias("copy_no")).distinct()
