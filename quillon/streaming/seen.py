"""First sightings as a stream: what was seen once is not taken again, also after a restart.

Each batch is compared with all keys stored so far, as in `store.unseen`, so no key is ever forgotten and
no row is too late; a batch that is run again after a failure finds its own rows stored. A row without a
key counts as one key. Of the rows of a key in one batch the earliest is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.store import earliest


def take_unseen(target: str, key: str, at: str) -> Callable[[DataFrame, int], None]:
    """Adds to `target` the first row of each key of a batch that is not stored there yet."""

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # with the batch's schema a folder without rows can be read as well
        spark.createDataFrame([], batch.schema).write.mode("append").parquet(target)
        stored = spark.read.schema(batch.schema).parquet(target).select(key).distinct().withColumnRenamed(key, "_stored")
        new = batch.join(stored, batch[key].eqNullSafe(stored["_stored"]), "left_anti")
        earliest(new, [key], [at]).write.mode("append").parquet(target)

    return take


def run_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, at: str) -> None:
    """Take in what has arrived since the last run and stop."""
    rows = spark.readStream.schema(schema).parquet(source)
    q = rows.writeStream.foreachBatch(take_unseen(target, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
