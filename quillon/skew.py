"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

#: A key is heavy when it holds at least this share of the rows; so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001
SALTS = 64


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, salts: int = SALTS) -> DataFrame:
    """Inner join of `rows` with one row per key in `groups`, whose `count_col` says how many rows the key has.

    Rows of heavy keys (at least HEAVY_SHARE of the rows that `groups` counts, so at most 1000 keys,
    which are broadcast to mark their rows) are salted by a hash of the whole row, which a task that is run
    again gives alike, and their groups repeated once a salt: no task gets all different rows of a key,
    and `rows` is read once. `groups` should be stored, it is read three times.
    """
    total = groups.agg(F.sum(count_col).alias("n")).first()["n"] or 0
    limit = max(2, int(total * HEAVY_SHARE))
    heavy = groups.where(F.col(count_col) >= limit)
    marked = rows.join(F.broadcast(heavy.select(*keys, F.lit(True).alias("_heavy"))), keys, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int")).drop("_heavy")
    spread = F.when(F.col(count_col) >= limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(groups.withColumn("_salt", F.explode(spread)), [*keys, "_salt"]).drop("_salt")


#: Rows of one side that meet in a cell of `join_cells`.
CELL = 1000


def join_cells(left: DataFrame, right: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """Inner join of two sides that may both repeat a key very often.

    A key with more than `cell` rows on a side is cut into blocks by a hash of the whole row, and each block of
    one side meets each of the other: no task gets more than about cell x cell of its pairs at once. The blocks
    are stored (only keys beyond `cell`, so few), and broadcast up to BROADCAST_ROWS of them. Keys that are
    null join nothing. Both sides are read twice, so they should be stored.
    """
    def many(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias(name)).where(F.col(name) > 1)

    parts = cut(many(left, "_l").join(many(right, "_r"), keys, "full_outer"))
    n = parts.count()
    if not n:
        return left.join(right, keys)
    parts = F.broadcast(parts) if n <= BROADCAST_ROWS else parts

    def spread(rows: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        marked = rows.join(parts, keys, "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
        block = F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int")
        return marked.withColumns({i: block, j: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_l", "_r")

    return spread(left, "_l", "_r", "_i", "_j").join(spread(right, "_r", "_l", "_j", "_i"), [*keys, "_i", "_j"]).drop("_i", "_j")


def bundles(rows: DataFrame, keys: list[str], cols: list[str], size: int = CELL) -> DataFrame:
    """(keys ..., items): the rows of each key as lists of about `size` structs of `cols`, so that what they are joined with is repeated once a list.

    Keys with more rows are cut by a hash of the row; those keys are stored, and broadcast up to BROADCAST_ROWS of them.
    """
    many = cut(rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("_n")).where("_n > 1"))
    marked = rows.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, keys, "left")
    block = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_n", F.lit(1))).cast("int")
    return marked.groupBy(*keys, block.alias("_block")).agg(F.collect_list(F.struct(*cols)).alias("items")).drop("_block")


#: Keys are broadcast up to this number (8 MB of numbers), beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among `ids` (one column `key`, stored): few keys are sent to the rows, which then stay where they are."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_anti")
