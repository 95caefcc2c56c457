"""Repeated lines and the ledger of copies against brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import ledger
from quillon.llm import repeated_lines as R

DOCS = "doc_id long, source_id string, text string, h1 int, key string"


def brute_lines(rows, n):
    seen = collections.defaultdict(set)
    for doc, source, text, *_ in rows:
        if text is not None and source is not None:
            for line in text.split("\n"):
                if R.fold_line(line):
                    seen[source, R.fold_line(line)].add(doc)
    return {(doc, i) for doc, source, text, *_ in rows if text is not None and source is not None for i, line in enumerate(text.split("\n"), 1) if R.fold_line(line) and len(seen[source, R.fold_line(line)]) >= n}


def docs_of(seed):
    rnd = random.Random(seed)
    stock = ["Partager", "© 2026 Le Site. Tous droits réservés.", "x", "ligne  AVEC\tblancs", "Une phrase assez longue pour tenir en plusieurs morceaux, reprise telle quelle d'une page à l'autre du site."]
    rows = []
    for i in range(60):
        lines = [f"article {i} {rnd.random()}"] + [rnd.choice([s, s.upper(), f"  {s} ", s + " "]) for s in rnd.sample(stock, rnd.randint(0, 5))] + ["", " \t"]
        rnd.shuffle(lines)
        # a third of all rows have one source
        rows.append((i, "hot" if i % 3 == 0 else rnd.choice(["a", "b"]), "\n".join(lines), 1, "clash"))
    return rows


def test_lines_match_brute_force(spark):
    rows = docs_of(1) + [(100, "a", None, 1, ""), (101, None, "Partager", 1, ""), (102, "a", "", 1, "")]
    none = [(None, "hot", "Partager\nx", 1, "")] * 7
    rows += [(103, "a", "seule fois " * 50_000, 1, "")] + [(200, "c", "même ligne", 1, "")] * 6  # a long text; one document stored six times
    got = [tuple(r) for r in R.repeated_lines(spark.createDataFrame(rows + none, DOCS), 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_lines(rows, 5)


def test_exactly_the_threshold(spark):
    rows = [(i, "s", f"Ligne commune\npropre {i}", 0, "") for i in range(4)]
    assert R.repeated_lines(spark.createDataFrame(rows, DOCS), 5).count() == 0
    assert R.repeated_lines(spark.createDataFrame([*rows, (9, "s", "ligne  COMMUNE", 0, "")], DOCS), 5).count() == 5


def test_removal_keeps_rows_and_columns(spark):
    rows = docs_of(2) + [(100, "a", None, 7, "k")]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in R.remove_lines(df, R.repeated_lines(df, 5)).collect()}
    bad = brute_lines(rows, 5)
    assert len(out) == len(rows) and out[100]["text"] is None and out[100]["n_removed"] == 0 and out[100]["key"] == "k"
    for doc, _, text, *_ in rows[:-1]:
        assert out[doc]["text"] == "\n".join(x for i, x in enumerate(text.split("\n"), 1) if (doc, i) not in bad)


def test_empty_documents(spark):
    assert R.repeated_lines(spark.createDataFrame([], DOCS), 5).collect() == []


def test_chunks_depend_on_content_only():
    texts = [w.encode() for w in ("a", "bc" * 40, "é" * 100, "fin", "", "une ligne\nune autre ligne " * 20)]
    whole = R.chunk_texts(texts)
    for k, text in enumerate(texts):
        alone = R.chunk_texts([b"autre", text])
        for i in range(1, 5):
            assert np.array_equal(whole[i][whole[0] == k], alone[i][alone[0] == 1])
        # chunks cover the text without a gap
        b, e = whole[1][whole[0] == k], whole[2][whole[0] == k]
        assert (not text and not len(b)) or (b[0] == 0 and e[-1] == len(text) and np.array_equal(b[1:], e[:-1]))
    assert all(np.array_equal(x, y) for x, y in zip(R.chunk_texts(texts, 1), whole))
    # chunks come back after an insertion: content defines the cuts, not positions
    rnd = random.Random(3)
    text = " ".join(str(rnd.random()) for _ in range(300)).encode()
    a, b = R.chunk_texts([text])[3], R.chunk_texts([text[:40] + b"xyz" + text[40:]])[3]
    assert len(set(a.tolist()) & set(b.tolist())) > 0.9 * len(a)


CLAIMS = "no long, person string, axis string, quote_fr string, key string"


def brute_key(*fields):
    return tuple(None if f is None else "".join(c for c in f.lower() if c.isalnum()) for f in fields)


def test_ledger_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        q = "Il faut, vite !" if i % 3 == 0 else rnd.choice(["Été 2026", "ete 2026", "", None, "a-b", "ab", "A B"])
        rows.append((i, rnd.choice(["Ana ", "ana", None]), "x", q and rnd.choice([q, q.upper(), f"« {q} »"]), "k"))
    df = spark.createDataFrame(rows + rows[:5], CLAIMS)
    groups = collections.defaultdict(set)
    for no, p, a, q, _ in rows:
        groups[brute_key(p, a, q)].add(no)
    keys = ledger.keyed(df, "no", ["person", "axis", "quote_fr"])
    built = ledger.build(spark, [keys.where(F.col("no") % 4 == k) for k in (2, 0, 3, 1)])
    assert sorted((r["first_no"], r["copies"]) for r in built.collect()) == sorted((min(g), len(g)) for g in groups.values())
    got = sorted(tuple(r) for r in ledger.copies(keys, built).collect())
    assert got == sorted((min(g), n) for g in groups.values() for n in g if n != min(g))


def test_ledger_of_nothing(spark):
    none = spark.createDataFrame([], CLAIMS)
    keys = ledger.keyed(none, "no", ["person", "axis", "quote_fr"])
    built = ledger.build(spark, [keys])
    assert built.count() == 0 and ledger.copies(keys, built).count() == 0


def test_untouched_buckets_are_carried_over(spark):
    a = ledger.batch_counts(ledger.keyed(spark.createDataFrame([(5, "a", "x", "un", ""), (7, "b", "x", "deux", "")], CLAIMS), "no", ["person", "axis", "quote_fr"]))
    b = ledger.batch_counts(ledger.keyed(spark.createDataFrame([(3, "A", "x", "UN", "")], CLAIMS), "no", ["person", "axis", "quote_fr"]))
    assert sorted((r["first_no"], r["copies"]) for r in ledger.update(a, b).collect()) == [(3, 2), (7, 1)]


def test_lines_in_any_context(spark):
    # the same lines after other lines, at the end of a text and alone in it, long and short
    rnd = random.Random(9)
    stock = ["".join(rnd.choice("abcdefghij klm") for _ in range(n)).strip() or "x" for n in (1, 3, 8, 9, 17, 40, 64, 90, 130, 200, 400) for _ in range(3)]
    rows = []
    for i in range(80):
        lines = rnd.sample(stock, rnd.randint(0, 6)) + [f"seule {rnd.random()}" for _ in range(rnd.randint(0, 2))]
        rnd.shuffle(lines)
        rows.append((i, rnd.choice("ab"), "\n".join(lines), 0, ""))
    got = {tuple(r) for r in R.repeated_lines(spark.createDataFrame(rows, DOCS), 5).collect()}
    assert got == brute_lines(rows, 5)


def test_spans_of_texts_without_line_feeds(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    notice = "Reproduction  INTERDITE sans l'accord écrit de l'éditeur ; " + words(60) + " fin de la mention légale du site."
    rows = [(i, "s", f"{words(80)} {notice if i % 2 else notice.upper()} {words(70)}", i, "k") for i in range(12)] + [(50, "t", notice, 0, "k"), (51, "s", None, 0, "k"), (52, "s", "", 0, "k"), (53, None, notice, 0, "k")]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in R.cut_spans(df, 5).collect()}
    assert len(out) == len(rows) and out[50]["text"] == notice and out[53]["text"] == notice and out[51]["text"] is None and out[52]["text"] == ""
    for i in range(12):
        text, kept = rows[i][2], out[i]["text"]
        at = text.lower().index(notice.lower())
        assert out[i]["n_cut"] == 1 and kept.startswith(text[: at - 1]) and kept.endswith(text[at + len(notice) + 1 :])
        # only the ends of the notice, less than a few chunks, may stay
        assert len(kept) < len(text) - len(notice) + 400 and out[i]["h1"] == i
    assert R.cut_spans(df.limit(0), 5).count() == 0


def test_stored_ledger_takes_a_batch_once_and_leaves_other_buckets(spark, tmp_path):
    keys = lambda *rows: ledger.keyed(spark.createDataFrame(list(rows), CLAIMS), "no", ["person", "axis", "quote_fr"])
    led = ledger.Ledger(spark, str(tmp_path / "l"), buckets=16)
    first = [(i, f"p{i}", "x", "mot", "") for i in range(40)]
    assert led.apply("a", keys(*first)) and not led.apply("a", keys(*first))
    before = {r["key"]: (r["first_no"], r["copies"]) for r in led.rows().collect()}
    assert len(before) == 40 and set(before.values()) == {(i, 1) for i in range(40)}
    places = {r["bucket"]: r["place"] for r in led._manifest().collect()}
    # what a batch that failed left behind is written over
    (tmp_path / "l" / "data" / "b").mkdir()
    (tmp_path / "l" / "data" / "b" / "rest").write_text("x")
    assert led.apply("b", keys((100, "P3", "x", "MOT", ""), (101, "p3", "x", "mot!", "")))
    got = {(r["first_no"], r["copies"]) for r in led.rows().collect()}
    assert got == {(i, 3 if i == 3 else 1) for i in range(40)}
    now = [r for r in led._manifest().collect() if r["batch"] == "b"]
    assert len(now) == 1 and places[now[0]["bucket"]] != now[0]["place"]
    # an empty batch counts as taken in; another ledger on the same folder sees the same rows
    assert led.apply("c", keys((None, "p", "x", "y", ""))) and led.applied("c")
    again = ledger.Ledger(spark, str(tmp_path / "l"), buckets=16)
    assert not again.apply("b", keys((7, "q", "x", "z", ""))) and again.rows().count() == 40
