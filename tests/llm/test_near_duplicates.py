"""Versions of one text against all pairs by brute force."""

from __future__ import annotations

import random

from quillon.llm import near_duplicates as N

DOCS = "doc_id long, text string, rep long, n int"


def corpus(seed, families=25, alone=60):
    rnd = random.Random(seed)
    vocab = [f"mot{i}" for i in range(900)]
    common = [["ce", "projet", "le", "conseil", "le", "défend"], ["rien", "n'est", "réglé", "sur", "ce", "point"]]

    def text(n):
        out = []
        while len(out) < n:
            out += rnd.choice(common) if rnd.random() < 0.3 else [rnd.choice(vocab)]
        return out

    rows, no = [], 0
    for _ in range(families):
        base = text(rnd.randint(60, 200))
        for _ in range(rnd.randint(2, 5)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3, 8, 20])):
                i = rnd.randrange(len(words))
                if rnd.random() < 0.5:
                    words[i] = rnd.choice(vocab)
                else:
                    words.insert(i, rnd.choice(vocab))
            rows.append((no, rnd.choice([" ", "  ", "\n"]).join(words).capitalize(), 0, 0))
            no += 1
    for _ in range(alone):
        rows.append((no, " ".join(text(rnd.randint(5, 150))), 0, 0))
        no += 1
    rnd.shuffle(rows)
    return rows


def brute(rows, shape):
    sets = {}
    for doc, text, *_ in rows:
        w = N._WORDS.findall(text.lower()) if text else []
        if len(w) >= max(shape.min_words, shape.k):
            sets[doc] = {tuple(w[i : i + shape.k]) for i in range(len(w) - shape.k + 1)}
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= shape.threshold * len(sets[a] | sets[b])}


def test_all_pairs_match_brute_force(spark):
    rows = corpus(1)
    for shape in (N.Shape(3, 0.5, 30), N.Shape()):
        v = N.versions(spark.createDataFrame(rows, DOCS), shape)
        assert {tuple(r) for r in N.all_pairs(v).collect()} == brute(rows, shape)


def test_large_buckets_go_in_blocks(spark):
    rows = corpus(2, families=12, alone=30)
    shape = N.Shape(3, 0.5, 30)
    # buckets of more than three rows are split again, and at the last level compared in blocks
    for branch, passes in (((2.0,), 1), ((2.0,), 3), ((2.0, 2.0, 1.0), 1), ((2.0, 1.5), 2)):
        v = N.versions(spark.createDataFrame(rows, DOCS), shape, branch=branch, passes=passes, limit=3, block=4, runs=14)
        assert {tuple(r) for r in N.all_pairs(v, limit=2).collect()} == brute(rows, shape)


def test_groups_nulls_and_copies(spark):
    text = " ".join(f"w{i}" for i in range(120))
    near = text.replace("w60", "autre")
    rows = [(5, text, 0, 0), (9, text.upper(), 0, 0), (7, near, 0, 0), (7, near, 0, 0), (None, near, 0, 0), (1, None, 0, 0), (2, "", 0, 0), (3, "court", 0, 0), (4, " ".join(f"v{i}" for i in range(90)), 0, 0)]
    v = N.versions(spark.createDataFrame(rows, DOCS))
    got = {r["doc_id"]: (r["group_id"], r["n_links"], r["n_copies"]) for r in N.groups(v).collect()}
    assert got == {5: (5, 1, 2), 9: (5, 1, 2), 7: (5, 1, 1), 4: (4, 0, 1), 3: (3, 0, 1)}
    assert {tuple(r) for r in N.all_pairs(v).collect()} == {(5, 7), (5, 9), (7, 9)}
    none = N.versions(spark.createDataFrame([], DOCS))
    assert N.all_pairs(none).count() == 0 and N.groups(none).count() == 0


def test_a_chain_of_versions_is_one_group(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(8):
        words = [*words[10:], *[f"x{i}_{j}" for j in range(10)]]
        rows.append((i, " ".join(words), 0, 0))
    got = {r["group_id"] for r in N.groups(N.versions(spark.createDataFrame(rows, DOCS))).collect()}
    assert got == {0}


def test_runs_reach_the_target_at_every_depth():
    for t in (0.5, 0.8):
        # each level keeps at least one shared path on average, and the runs suffice at the greatest depth
        assert all(width * 2 * t / (1 + t) >= 1 for width in N.BRANCH)
        runs = N.runs_for(t)
        shared, found = 2 * t / (1 + t), 0
        rng = N.np.random.default_rng(3)
        for _ in range(3000):
            paths = N.np.ones(runs, int)
            for width in N.BRANCH * N.PASSES:
                # many paths die out no more
                paths = rng.poisson(N.np.minimum(paths, 1000) * width * shared)
            found += paths.any()
        assert found / 3000 >= N.TARGET_RECALL - 0.005


def test_pairs_in_hot_groups_are_found(spark):
    # all texts are versions of one, so every bucket is split down to the last level
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rnd.random() > 0.055 else f"x{i}_{k}" for k, w in enumerate(base)), 0, 0) for i in range(60)]
    shape = N.Shape(3, 0.5, 30)
    want = brute(rows, shape)
    got = {tuple(r) for r in N.all_pairs(N.versions(spark.createDataFrame(rows, DOCS), shape, limit=3, block=4)).collect()}
    assert got <= want and len(got) >= N.TARGET_RECALL * len(want)


def test_short_copies_and_short_texts(spark):
    rows = [(1, "Deux mots", 0, 0), (2, "deux  MOTS !", 0, 0), (3, "mots deux", 0, 0), (4, "a b c d e", 0, 0), (5, "A, b c d e.", 0, 0), (6, "...", 0, 0)]
    v = N.versions(spark.createDataFrame(rows, DOCS))
    assert {tuple(r) for r in N.all_pairs(v).collect()} == {(1, 2), (4, 5)}
    got = {r["doc_id"]: r["group_id"] for r in N.groups(v).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_a_hub_and_a_hot_class_are_joined_in_cells(spark, monkeypatch):
    from quillon import skew

    monkeypatch.setattr(skew.join_cells, "__defaults__", (3,))
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base), 0, 0) for i in range(12)]
    rows += [(20 + i, " ".join(w if k != 7 * i + 3 else f"x{i}" for k, w in enumerate(base)), 0, 0) for i in range(14)]
    rows += [(50 + i, " ".join(rnd.choice(["q", "r", "s", "t"]) + str(rnd.randrange(500)) for _ in range(120)), 0, 0) for i in range(5)]
    shape = N.Shape(3, 0.5, 30)
    v = N.versions(spark.createDataFrame(rows, DOCS), shape)
    want = brute(rows, shape)
    assert {tuple(r) for r in N.all_pairs(v, limit=4).collect()} == want
    degree = {}
    for a, b in want:
        degree.setdefault(a, set()).add(b)
        degree.setdefault(b, set()).add(a)
    got = {r["doc_id"]: r["group_id"] for r in N.groups(v).collect()}
    assert all(got[d] == 0 for d in degree) and len(got) == len(rows)


def test_remembered_word_hashes_change_no_set(monkeypatch):
    import numpy as np

    from quillon.llm import near_duplicates as N

    texts = ["un deux trois quatre", None, "quatre trois deux un", "", "Un deux, trois quatre"]
    first = N.shingle_sets(texts, N.Shape(k=2))
    monkeypatch.setattr(N, "KNOWN_WORDS", 0)
    again = N.shingle_sets(texts, N.Shape(k=2))
    assert [x is None for x in first] == [False, True, False, True, False] == [x is None for x in again]
    assert all(np.array_equal(a, b) for a, b in zip(first, again) if a is not None) and np.array_equal(first[0], first[4]) and set(N._HASHES) == {"un", "deux", "trois", "quatre"}
