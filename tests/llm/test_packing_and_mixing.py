"""Packs and mixes: nothing lost, capacities and repeats kept, shares reached."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, packing, tokens

SIZED = "doc_id long, n_tokens long, pack_id int, source string"


def test_differencing_is_even_and_whole():
    rnd = random.Random(1)
    for _ in range(50):
        sizes = [rnd.randint(0, 100) for _ in range(rnd.randint(0, 60))]
        k = rnd.randint(1, 9)
        w = packing.differencing(sizes, k)
        assert sorted(i for x in w for i in x) == list(range(len(sizes))) and len(w) <= k
        if len(sizes) >= 6 * k:
            sums = [sum(sizes[i] for i in x) for x in w]
            assert max(sums) - min(sums) <= 15


def test_windows_keep_the_capacity():
    rnd = random.Random(2)
    for cap in (64, 512):
        sizes = [rnd.randint(0, cap) for _ in range(300)]
        w = packing.pack_block(sizes, cap)
        assert sorted(i for x in w for i in x) == list(range(300))
        assert all(sum(sizes[i] for i in x) <= cap for x in w)
        assert sum(sizes) / (len(w) * cap) > 0.93


def test_packs(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 10, 100, 700, 1024, 5000]), 9, "x") for i in range(500)] + [(7, 10, 9, "x")]  # one row stored twice under another size
    caps = spark.createDataFrame([(1, 512, "a"), (2, 2048, "b"), (3, 0, "none")], "pack_id int, capacity_tokens int, label string")
    p = packing.packs(spark.createDataFrame(rows, SIZED), caps, block_items=120).collect()
    for pack, cap in ((1, 512), (2, 2048)):
        mine = [r for r in p if r["pack_id"] == pack]
        assert sum(r["n_tokens"] for r in mine) == sum(r[1] for r in rows)
        windows = {}
        for r in mine:
            windows.setdefault(r["window_id"], []).append(r)
        for w in windows.values():
            total = sum(r["n_tokens"] for r in w)
            assert total <= cap and {r["window_tokens"] for r in w} == {total} and {r["fill"] for r in w} == {total / cap}
        assert all(r["piece_no"] == 1 for r in mine if dict((a, b) for a, b, *_ in rows[:500])[r["doc_id"]] <= cap)
    f = {r["pack_id"]: r for r in packing.fills(packing.packs(spark.createDataFrame(rows, SIZED), caps)).collect()}
    assert f[1]["n_tokens"] == sum(r[1] for r in rows) and 0.9 < f[2]["mean_fill"] <= 1
    assert packing.packs(spark.createDataFrame([], SIZED), caps).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Un été à l'école.", "s", 3), (2, None, "s", 3), (3, "", None, 3), (None, "x", "s", 3)], "doc_id long, text string, source string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, ["source"]).collect()}
    assert got == {1: len(tokens.encoder().encode_ordinary("Un été à l'école.")), 2: 0, 3: 0}
    text = "Débats – compte rendu 2026"
    assert tokens.encoder().decode(tokens.encoder().encode_ordinary(text)) == text


@pytest.fixture(scope="module")
def sized(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(50, 150), 0, "big" if i % 3 else "small") for i in range(3000)] + [(9000, 100, 0, None), (9001, 100, 0, "untargeted"), (9002, 0, 0, "small")]
    return spark.createDataFrame(rows, SIZED)


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_the_shares(spark, sized):
    t = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("empty", 0.1, 4)], TARGETS)
    rate = mixing.rates(sized, t)
    mix = mixing.mixed(sized, rate)
    s = {r["source"]: r for r in mixing.shares(mix, rate).collect()}
    assert s["empty"]["share"] == 0 and s["untargeted"]["used_docs"] == 0
    assert abs(s["big"]["share"] - 0.4 / 0.9) < 0.02 and abs(s["small"]["share"] - 0.5 / 0.9) < 0.02
    assert all(r["most_repeats"] <= (r["max_repeats"] or 0) for r in s.values())
    assert abs(sum(r["share"] for r in s.values()) - 1) < 1e-9
    # the same seed draws the same documents, whatever the partitions
    again = mixing.mixed(sized.repartition(7), rate)
    assert mix.exceptAll(again.select(*mix.columns)).count() == 0
    low, high = mix.where("source = 'small'").agg(F.min("repeats"), F.max("repeats")).first()
    assert high - low <= 1


def test_mix_of_a_given_size_is_capped(spark, sized):
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    rate = mixing.rates(sized, t, mix_tokens=10_000_000)
    s = {r["source"]: r for r in mixing.shares(mixing.mixed(sized, rate), rate).collect()}
    assert s["small"]["most_repeats"] == 2 and s["big"]["most_repeats"] == 1 and s["big"]["used_docs"] == s["big"]["n_docs"]


def test_mix_of_nothing(spark, sized):
    t = spark.createDataFrame([("big", 0.5, 1)], TARGETS)
    rate = mixing.rates(sized.limit(0), t)
    mix = mixing.mixed(sized.limit(0), rate)
    assert mix.count() == 0 and [r["share"] for r in mixing.shares(mix, rate).collect()] == [0.0]
    assert mixing.mixed(sized, mixing.rates(sized, t.limit(0))).count() == 0
