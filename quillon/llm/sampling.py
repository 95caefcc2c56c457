"""Bounded samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, key: str, n: int) -> list[Row]:
    """The `n` rows that come first by hash of `key`.

    Only the share of the hash range that surely holds them is sorted, so that tasks don't each send
    `n` rows: four times as many rows as asked are expected there.
    """
    total = rows.count()
    low = rows
    if total > 4 * n:
        low = rows.where(F.xxhash64(key) < F.lit(int(-(2**63) + 2**64 * (4 * n / total))))
    got = low.orderBy(F.xxhash64(key), key).limit(n).collect()
    # a key that is repeated very often may leave that share nearly empty: then all rows are sorted
    return got if len(got) == min(n, total) else rows.orderBy(F.xxhash64(key), key).limit(n).collect()
