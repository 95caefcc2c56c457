"""Texts put into windows of fixed capacity with little room left.

Method: Karmarkar-Karp multiway differencing. Within a block of items every item is a partial
partition of k windows; the two partitions of the largest imbalance are merged, the fullest windows
of the one with the emptiest of the other, until one partition of near-equal windows is left; where a
window exceeds the capacity, k rises and the differencing is done again, then a smaller k is tried in between. k starts at the least that
could do. Differencing makes all windows alike; where that leaves room, the emptiest are dissolved, the largest item first
into the fullest window that holds it, as long as that frees a window. Items longer than the capacity, and only these, are split: full windows and a rest.

Blocks are made by a hash of doc_id, of about `block_items` items each, their number following the
number of items; so a block is bounded, whatever the sizes are, and costs at most one window's room.

Defined results: items of 0 tokens (null or empty texts) are members of some window and use no room;
repeated rows are items of their own, told apart by a running number; no items, no windows.
"""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 750
#: Packs up to this number are broadcast.
MANY = 10_000
#: Halvings between the last number of windows that was too small and the first that fits.
BACK = 4


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of item numbers with near-equal sums."""
    # a partition is kept as its windows that aren't empty, the fullest first: [(sum, items)]; the other windows hold 0
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spare = k - len(a)
        if len(b) <= spare:  # b's windows meet a's empty ones
            merged = a + b
        else:
            over = len(b) - spare  # b's smallest windows meet a's smallest, the fuller with the emptier
            head, tail = b[:spare], b[spare:]
            cut = len(a) - over
            merged = a[:cut] + head + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[cut:], reversed(tail))]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        # what all windows have in common stays in the sums: only differences order the heap
        heapq.heappush(heap, (least - merged[0][0], tie, merged))
        tie += 1
    return [list(w[1]) for w in heap[0][2]] if heap else []


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items whose sums stay within the capacity; no size may exceed it."""

    def attempt(k: int) -> tuple[list[list[int]], int]:
        windows = differencing(sizes, k)
        return windows, max((sum(sizes[i] for i in w) for w in windows), default=0)

    k = max(1, -(-sum(sizes) // capacity))
    low = k - 1
    windows, most = attempt(k)
    while most > capacity:
        # the further the fullest window is beyond the capacity, the larger the step
        low, k = k, k + max(1, int(k * (most / capacity - 1)))
        windows, most = attempt(k)
    for _ in range(BACK):
        middle = (low + k) // 2
        if middle <= low:
            break
        fewer, most = attempt(middle)
        if most <= capacity:
            k, windows = middle, fewer
        else:
            low = middle
    return dissolve([w for w in windows if w], sizes, capacity)


def dissolve(windows: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """The windows with as many of the emptiest as can be freed given away to the others.

    The `k` emptiest windows are emptied together and their items put into the fullest window that holds each, the
    largest first; what finds no room opens windows anew. Kept where that takes fewer windows; k is doubled as long as it helps.
    """
    best, k = windows, 1
    while k < len(windows):
        order = sorted(best, key=lambda w: sum(sizes[i] for i in w))
        items = sorted((i for w in order[:k] for i in w), key=lambda i: -sizes[i])
        kept = [list(w) for w in order[k:]]
        room = sorted((capacity - sum(sizes[i] for i in w), n) for n, w in enumerate(kept))
        for i in items:
            at = bisect.bisect_left(room, (sizes[i], -1))
            if at == len(room):
                kept.append([i])
                bisect.insort(room, (capacity - sizes[i], len(kept) - 1))
            else:
                left, n = room.pop(at)
                kept[n].append(i)
                bisect.insort(room, (left - sizes[i], n))
        if len(kept) < len(best):
            best = kept
        k *= 2
    return best


def pieces(sized: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row per item and capacity: whole texts, and of longer ones full pieces and a rest."""
    caps = capacities.select("pack_id", "capacity_tokens")
    # every item goes into every pack; a small table of packs is sent to the items
    x = sized.select("doc_id", "n_tokens").crossJoin(F.broadcast(caps) if caps.limit(MANY + 1).count() <= MANY else caps)
    cap = F.col("capacity_tokens")
    n = F.greatest(F.ceil(F.col("n_tokens") / cap), F.lit(1)).cast("int")
    x = x.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n)))
    start = (F.col("piece_no") - 1).cast("long") * cap
    return x.select("pack_id", "capacity_tokens", "doc_id", "piece_no", start.alias("start_token"), F.least(F.col("n_tokens") - start, cap.cast("long")).alias("n_tokens"))


_OUT = "pack_id int, window_id string, doc_id long, piece_no int, start_token long, n_tokens long, window_tokens long, fill double"


def packs(sized: DataFrame, capacities: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(pack_id, window_id, doc_id, piece_no, start_token, n_tokens, window_tokens, fill): one row per member.

    window_id names a window within its pack: b<block>-<number>, or, of a piece that fills one, d<doc_id>-<piece>-<row>.
    sized: (doc_id, n_tokens), stored; capacities: (pack_id, capacity_tokens).
    """
    caps = capacities.where("capacity_tokens > 0").select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("int").alias("capacity_tokens")).distinct()
    items = pieces(sized, caps)
    full = items.where(F.col("n_tokens") == F.col("capacity_tokens"))
    rest = items.where(F.col("n_tokens") < F.col("capacity_tokens"))
    n_blocks = max(1, -(-sized.count() // block_items))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(n_blocks)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        sizes, cap = pdf["n_tokens"].astype(int).tolist(), int(pdf["capacity_tokens"].iloc[0])
        of, total = [0] * len(sizes), [0] * len(sizes)
        for no, w in enumerate(pack_block(sizes, cap), 1):
            t = sum(sizes[i] for i in w)
            for i in w:
                of[i], total[i] = no, t
        pdf["window_id"], pdf["window_tokens"] = [f"b{b}-{n}" for b, n in zip(pdf["block"], of)], total
        pdf["fill"] = pdf["window_tokens"] / cap
        return pdf[[c.split()[0] for c in _OUT.split(", ")]]

    packed = rest.groupBy("pack_id", "block").applyInPandas(run, _OUT)
    # rows that are stored twice fill a window each, so the number of the row goes in; `sized` is stored, so it stays
    copy = F.monotonically_increasing_id()
    whole = full.select(
        "pack_id", F.concat(F.lit("d"), F.col("doc_id"), F.lit("-"), F.col("piece_no"), F.lit("-"), copy).alias("window_id"), "doc_id", "piece_no", "start_token", "n_tokens", F.col("n_tokens").alias("window_tokens"), F.lit(1.0).alias("fill")
    )
    return packed.unionByName(whole)


def fills(members: DataFrame) -> DataFrame:
    """(pack_id, n_windows, n_members, n_tokens, mean_fill): how well the windows of each capacity are used."""
    w = members.groupBy("pack_id", "window_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("fill").alias("fill"))
    return w.groupBy("pack_id").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_members"), F.sum("tokens").alias("n_tokens"), F.avg("fill").alias("mean_fill"))
