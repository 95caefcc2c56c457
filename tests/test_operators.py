"""Relational operators on small tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import extraction, gates, positions, routing, site, store, transcripts
from quillon.skew import bundles, join_cells, join_counted, without

DAY = dt.date(2026, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_latest_earliest_merge(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, None), (None, 1, "n")], "id string, seq int, v string")
    assert rows(store.latest(a, ["id"], ["seq"])) == [("k", 3, "z"), (None, 1, "n")]
    assert rows(store.earliest(a, ["id"], ["seq"])) == [("k", 1, "x"), (None, 1, "n")]
    new = spark.createDataFrame([("k", 9, "edited"), ("m", 2, "b"), ("m", 1, "a")], a.schema)
    assert ("m", 1, "a") in rows(store.merge(a, new, "id", ["seq"])) and ("k", 9, "edited") not in rows(store.merge(a, new, "id", ["seq"]))


def test_silent_sources(spark):
    def runs(*fetched, sid):
        return [(sid, i, dt.datetime(2026, 1, 1), f, 0) for i, f in enumerate(fetched)]

    df = spark.createDataFrame(runs(5, 0, 0, 0, sid="dead") + runs(0, 0, sid="young") + runs(0, 0, 0, 1, sid="back") + runs(25, 25, 25, sid="kept0") + runs(0, 0, sid="twice") + runs(0, 0, sid="twice"), "source_id string, seq int, run_at timestamp, fetched int, kept int")
    assert rows(store.silent_sources(df)) == [("dead",)]
    report = rows(store.run_report(df, store.silent_sources(df)), "source_id", "empty", "silent")
    assert ("dead", False, True) in report and ("young", True, False) in report


def test_routing_and_names(spark):
    docs = spark.createDataFrame([(1, "3", None, "u1", "p", "s", DAY), (2, "1", "t", "u2", "p", "s", DAY)], "doc_id int, tier string, title string, url string, person string, source_id string, doc_date date")
    assert rows(routing.kept_documents(docs), "doc_id") == [(2,)]
    assert rows(routing.to_leads(docs), "title", "url") == [("(untitled)", "u1")]
    people = spark.createDataFrame([("ana", ["Ana Sol", "Édith"]), ("bo", ["Bo"]), ("none", [])], "slug string, match_names array<string>")
    items = spark.createDataFrame([(1, "ANA SOL et bo"), (2, "Bora et Ana"), (3, "édith, Ana Sol"), (4, None)], "id int, t string")
    assert rows(routing.attributed(items, F.col("t"), people), "id", "named_person") == [(1, "ana"), (1, "bo"), (3, "ana")]


CLAIM = "claim_no long, claim_id string, person string, axis string, claim_date date, quote_fr string, position_fr string, position_en string, contexte_fr string, contexte_en string, tier string, tier_confirmed boolean, source_url string, archive_url string"
GOOD = "https://a.example/web/20260101000000/x"


def claim(no, **kw):
    base = {"claim_no": no, "claim_id": f"c{no}", "person": "ana", "axis": "emploi", "claim_date": DAY, "quote_fr": "mot pour mot", "position_fr": "", "position_en": "", "contexte_fr": "", "contexte_en": "", "tier": "1", "tier_confirmed": True, "source_url": "u", "archive_url": GOOD}
    return tuple((base | kw)[c.split()[0]] for c in CLAIM.split(", "))


DOC = "doc_id long, url string, text string, archive_url string, fetched_at timestamp"


def test_gates(spark):
    c = spark.createDataFrame(
        [claim(1), claim(2, quote_fr="mot pour\nmot"), claim(3, quote_fr="Mot pour mot"), claim(4, source_url="nowhere"), claim(5, archive_url=None, position_fr="Ambitieuse et vague, mais irréaliste", quote_fr="ancien")], CLAIM)
    d = spark.createDataFrame([(1, "u", "mot pour\nmot", None, None), (2, "u", "ancien texte", None, None), (3, "u", None, None, None)], DOC)
    assert rows(gates.quote_hits(c, d)) == [(1, True), (2, True), (3, False), (4, None), (5, True)]
    found = rows(gates.all_gates(c, d), "gate", "claim_no", "message")
    assert [f[:2] for f in found].count(("neutrality", 5)) == 3
    assert ("archive", 5, "no capture") in found and ("provenance", 4, "no stored version of the source") in found
    assert rows(gates.verdict(gates.all_gates(c, d))) == [(6, 0, True)]
    links = gates.dead_links(c, spark.createDataFrame([("u",)], "url string"))
    assert rows(links, "claim_no", "fatal") == [(4, False)]


def test_attach_archives(spark):
    c = spark.createDataFrame([claim(1, archive_url=None), claim(2, archive_url="https://a.example/web/2026/x", quote_fr="absent"), claim(3, archive_url="", source_url="w"), claim(4)], CLAIM)
    old, new = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    d = spark.createDataFrame([(1, "u", "mot pour mot", GOOD + "2", new), (2, "u", "mot  pour mot", GOOD + "1", old), (3, "w", "mot pour mot", None, old)], DOC)
    assert rows(routing.attach_archives(c, d)) == [(1, GOOD + "1", True, False), (2, None, False, False), (3, None, False, True)]


def test_queue(spark):
    want = spark.createDataFrame([("a:0", "h1"), ("a:1", "h2"), ("b:0", "h3")], "custom_id string, text_sha256 string")
    sent = spark.createDataFrame([("a:0", "h1"), ("a:1", "old")], want.schema)
    assert rows(extraction.unsent(want, sent)) == [("a:1", "h2"), ("b:0", "h3")]
    b = spark.createDataFrame([("x",), ("y",)], "batch_id string")
    assert rows(extraction.pending_batches(b, b.where("batch_id = 'x'"))) == [("y",)]


def test_answers(spark):
    ok = '{"axis":"emploi","claim_type":"vote","date":"2026-01-02","quote_fr":" mot pour mot ","quote_gloss_en":"g","position_fr":"p","person":"ana","tier":"1"}'
    bad = [ok.replace('"emploi"', '"inconnu"'), ok.replace('"tier"', '"extra"'), ok[:40], "null", "[]", "", None, ok.replace(" mot pour mot ", " ".join(["m"] * 41)), ok.replace('"g"', '" "'), "{,}"]
    p = spark.createDataFrame([(i, "h:0", "b", x) for i, x in enumerate([ok, *bad])], "record_no int, custom_id string, batch_id string, payload string")
    a = extraction.parsed(p)
    assert rows(a, "record_no", "valid")[0] == (0, True) and not any(v for _, v in rows(a, "record_no", "valid") if _ != 0)
    why = dict(rows(p.select("record_no", extraction.unusable_reason(F.col("payload")))))
    assert why[0] is None and why[3] == "truncated" and why[6] == why[7] == "empty" and why[10] == "unparseable"
    kinds = "url_hash string, url string, archive_url string, tier_confirmed boolean, cues array<struct<t:int,line:string>>, fetched_at timestamp, doc_id long, person string, tier string"
    d = spark.createDataFrame([("h", "u", GOOD, False, [(1, "x")], None, 1, "bea", "2")], kinds)
    assert rows(extraction.collected(a, d), "claim_type", "claim_date", "quote_fr") == [("video", dt.date(2026, 1, 2), "mot pour mot")]
    # person and tier are the document's, the second is that of the cue in which the quote begins
    d = spark.createDataFrame([("h", "u", GOOD, False, [(1, "x"), (7, "un mot pour"), (9, "mot de fin")], None, 1, "bea", "2")], kinds)
    assert rows(extraction.collected(a, d, "2026-02-03"), "person", "tier", "timestamp_s", "last_verified") == [("bea", "2", 7, dt.date(2026, 2, 3))]
    d = spark.createDataFrame([("h", "u", None, True, None, None, 1, None, None)], kinds)
    assert rows(extraction.collected(a, d), "claim_type", "timestamp_s", "person", "last_verified") == [("vote", None, None, None)]


def test_result_lines_in_their_order(spark):
    def line(content, refusal="", finish="stop", status=200, error="null"):
        return f'{{"custom_id":"c","error":{error},"response":{{"status_code":{status},"body":{{"choices":[{{"message":{{"content":{content},"refusal":"{refusal}"}},"finish_reason":"{finish}"}}]}}}}}}'

    lines = [line('"{}"'), line('"{"', "no", "length", 500, '"boom"'), line('"{"', "no", "length", 500), line('"{"', "no", "length"), line('""', "", "length"), line('" "'), line('"{"'), line("null"), "", " ", "{broken", '{"custom_id":"x"}']
    got = dict((r["no"], r["reason"]) for r in extraction.results(spark.createDataFrame(list(enumerate(lines)), "no int, line string")).collect())
    assert got == {0: None, 1: "error: boom", 2: "status 500", 3: "refused: no", 4: "truncated", 5: "empty", 6: "unparseable", 7: "empty", 10: "status unknown", 11: "status unknown"}
    assert extraction.results(spark.createDataFrame([], "no int, line string")).count() == 0


def test_names_that_begin_others(spark):
    people = spark.createDataFrame([("a", ["Jean Dupont", "Dupont"]), ("b", ["Dupont-Aigle"]), ("c", ["Dupont d'Arc", "Île+"]), ("d", ["Jean"]), ("e", None), ("f", [])], "slug string, match_names array<string>")
    texts = ["Jean Dupont parle", "dupont-aigle parle", "M. Dupont d'Arc", "Dupontel et Jeannot", "île+ et l'Île", None, "", "jean DUPONT-AIGLE"]
    df = spark.createDataFrame(list(enumerate(texts)), "no int, text string")
    want = [(0, "a"), (0, "d"), (1, "a"), (1, "b"), (2, "a"), (2, "c"), (7, "a"), (7, "b"), (7, "d")]
    assert rows(routing.attributed(df, F.col("text"), people).select("no", "named_person")) == want
    assert routing.attributed(df, F.col("text"), people.limit(0)).count() == 0


def test_promotion_by_first_reason(spark):
    leads = spark.createDataFrame([(i, f"u{i}", "ana", t, i) for i, t in enumerate(["Ana et Bob", "Ana seule", "Ana ici", "Ana là", "Ana encore", "Ana dit", None])] + [(50, "u1", "ana", "Ana seule", 1), (51, "u9", "ana", "Ana", 1)], "lead_no int, url string, person string, title string, video_id int")
    captions = spark.createDataFrame([(2, "rien"), (3, "le sujet"), (4, "sujet")], "video_id int, text string")
    own = spark.createDataFrame([(1, "mon sujet"), (2, "sujet"), (4, "autre chose"), (5, None)], "video_id int, text string")
    done = spark.createDataFrame([("u9", "ana")], "url string, person string")
    names = spark.createDataFrame([("ana", ["Ana"]), ("bob", ["Bob"])], "slug string, match_names array<string>")
    got = dict(rows(routing.promotion(leads, routing.named(F.col("title"), routing.name_patterns(names)), captions, own, lambda c: F.coalesce(F.contains(c, F.lit("sujet")), F.lit(False)), done)))
    assert got == {0: "title names another or several", 1: "promoted", 2: "captions off subject", 3: "no dominant voice", 4: "own words off subject", 5: "own words off subject", 6: "title names another or several"}


def test_joins_in_cells_and_bundles(spark):
    left = spark.createDataFrame([("hot" if i < 40 else f"k{i % 5}" if i % 7 else None, i) for i in range(90)], "k string, a int")
    right = spark.createDataFrame([("hot" if i < 25 else f"k{i % 5}", 1000 + i) for i in range(60)] + [(None, 1)], "k string, b int")
    want = sorted((r["k"], r["a"], s["b"]) for r in left.collect() for s in right.collect() if r["k"] is not None and r["k"] == s["k"])
    for cell in (3, 10, 1000):
        assert sorted(tuple(r) for r in join_cells(left, right, ["k"], cell).select("k", "a", "b").collect()) == want
    got = bundles(left, ["k"], ["a"], 10).collect()
    assert sorted((x["a"], r["k"]) for r in got for x in r["items"] if r["k"]) == sorted((r["a"], r["k"]) for r in left.collect() if r["k"])
    assert sum(r["k"] == "hot" for r in got) > 1 and bundles(left.limit(0), ["k"], ["a"]).count() == 0


VTT = """WEBVTT

00:00:10.000 --> 00:00:12.000
bonjour<00:00:10.500><c> à tous</c>

00:00:12.000 --> 00:00:13.000
bonjour à tous

00:00:12.500 --> 00:00:13.000
<c>bonjour à tous</c>
00:01:02.100 --> 00:01:03.000
<c> suite </c>
<c> </c>
"""


def test_captions(spark):
    f = spark.createDataFrame([(1, VTT), (2, None), (3, "")], "id int, text string")
    assert rows(transcripts.caption_cues(f, "id"), "t", "line") == [(10, "bonjour à tous"), (62, "suite")]


def test_locate(spark):
    cues = [(5, "un deux"), (9, "trois quatre"), (20, "cinq")]
    df = spark.createDataFrame([(1, cues, "deux trois"), (2, cues, " cinq "), (3, cues, "six"), (4, [], "x"), (5, None, "x"), (6, cues, "un")], "id int, cues array<struct<t:int,line:string>>, q string")
    assert rows(df.select("id", transcripts.locate(F.col("cues"), F.col("q")))) == [(1, 5), (2, 20), (3, None), (4, None), (5, None), (6, 5)]


def test_voices(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 2.0, "0", "a"), (1, 2, 2.0, 9.0, "1", "b"), (1, 3, 9.0, 12.0, "1", "c"), (2, 1, 0.0, 5.0, "0", "x"), (2, 2, 5.0, 10.0, "1", "y")], "video_id int, turn_no int, start_s double, end_s double, voice string, text string")
    v = transcripts.dominant_voices(t)
    assert rows(v, "video_id", "voice") == [(1, "1")]  # half is not more than half
    assert rows(transcripts.voice_texts(t, v)) == [(1, "1", 2, "b c")]
    assert len(rows(transcripts.sample_turns(t))) == 12


def test_segments(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 28.0), (1, 2, 1.0, 58.0), (1, 3, 5.0, 5.0)], "video_id int, turn_no int, start_s double, end_s double")
    assert rows(transcripts.segments(t)) == [(1, 1, 0, 0.0, 28.0), (1, 2, 0, 1.0, 29.0), (1, 2, 1, 29.0, 57.0), (1, 2, 2, 57.0, 58.0)]


def test_expired_batches_go_back(spark):
    sent = spark.createDataFrame([("a:0", "b1"), ("a:1", "b2")], "custom_id string, batch_id string")
    assert rows(extraction.requeued(sent, sent.where("batch_id = 'b2'")), "custom_id") == [("a:0",)]


def test_reliability_ladder(spark):
    c = spark.createDataFrame(
        [claim(1), claim(2, source_url="v"), claim(3, axis="peur"), claim(4, axis="defense", tier_confirmed=False), claim(5, axis="defense", source_url="v"), claim(6, axis="securite", claim_date=None, tier="2", archive_url="x"), claim(7, axis="securite", source_url="v")], CLAIM)
    got = {r["axis"]: (r["reliability"], r["caveats"]) for r in positions.reliability(c).collect()}
    assert got["emploi"] == ("attested", [])
    assert got["peur"] == ("thin", ["single source"])
    assert got["defense"] == ("sourced", ["tier unconfirmed"])
    assert got["securite"] == ("thin", ["undated quote", "no usable capture", "not the person's own words"])


def test_grid_and_states(spark):
    c = spark.createDataFrame([claim(1), claim(2, claim_date=None), claim(3, person="unknown"), claim(4, axis="peur"), claim(5, axis="peur")], CLAIM)
    people = spark.createDataFrame([("ana", [(True,)]), ("bo", [(False,)]), ("cy", None), ("di", [(None,)])], "slug string, sources array<struct<enabled:boolean>>")
    g = positions.grid(c, people, ["emploi", "peur", "defense"])
    assert len(rows(g)) == 12
    assert [r for r in rows(g, "person", "axis", "claim_id") if r[2]] == [("ana", "emploi", "c2"), ("ana", "peur", "c5")]
    s = {(r["person"], r["axis"]): r["state"] for r in positions.cell_states(g, positions.monitored(people)).collect()}
    assert s["ana", "emploi"] == "claim" and s["ana", "defense"] == "none" and s["bo", "peur"] == "unmonitored" and s["di", "peur"] == "none" and s["cy", "peur"] == "unmonitored"


def test_trace(spark):
    c = spark.createDataFrame([claim(1), claim(2)], CLAIM)
    assert rows(positions.trace(positions.evidence(c), c.where("claim_no = 1"))) == [("ana", "emploi", 1, 1)]


def test_scorecard(spark):
    gold = spark.createDataFrame([("a", "emploi", "L’IA avance"), ("a", "peur", "jamais dit"), ("b", None, None), ("c", None, None), ("d", "emploi", "x"), ("gone", "emploi", "x")], "url_hash string, axis string, quote string")
    said = spark.createDataFrame([("a", 2, "peur", "l'ia  AVANCE vite"), ("a", 1, "emploi", "l'ia avance"), ("b", 1, None, None), ("c", 1, "emploi", "inventé")], "url_hash string, pos int, axis string, quote string")
    docs = spark.createDataFrame([("a", "dit : l'ia avance, vite"), ("b", "b"), ("c", "c"), ("d", "d")], "url_hash string, text string")
    r = positions.scorecard(gold, said, docs).first()
    assert (r["documents"], r["expected_empty"], r["failures"], r["kept_empty"], r["gold_quotes"]) == (4, 2, 1, 1, 3)
    assert (r["quotes"], r["verbatim"], r["found"], r["agreed"]) == (3, 1, 1, 1)
    assert r["discipline"] == 0.5 and r["recall"] == round(1 / 3, 6) and r["axis_agreement"] == 1.0
    empty = positions.scorecard(gold.limit(0), said.limit(0), docs.limit(0)).first()
    assert empty["discipline"] is None and empty["recall"] is None and empty["fidelity"] is None


def test_site(spark):
    p = spark.createDataFrame([("ana",)], "slug string")
    pages = site.person_pages(p)
    assert rows(pages, "path") == [("/en/person/ana/",), ("/fr/personne/ana/",)]
    s = rows(site.sitemap(pages, "https://s.example"))
    assert len(s) == 6 and all(h == "https://s.example/fr/personne/ana/" for _, k, h in s if k == "x-default")
    c = spark.createDataFrame([("emploi",), ("autre",)], "axis string")
    assert rows(site.labelled(c, "axis", site.AXIS_LABELS, "en"), "axis", "label") == [("autre", "autre"), ("emploi", "Jobs")]


def test_join_counted_with_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    j = join_counted(big, groups, ["k"], "n")
    assert j.count() == 3000 and j.where("k = 0").count() == 1000 and j.columns == ["k", "id", "n", "first"]
    assert j.where("k = 0").agg(F.max("first")).first()[0] == 0 and j.select("id").distinct().count() == 3000


def test_judgement_words_are_prefixes(spark):
    df = spark.createDataFrame([claim(1, contexte_en="BOLDLY; kobold", contexte_fr="Timides flou-vague")], CLAIM)
    assert [m for _, m in rows(gates.neutrality(df), "gate", "message")] == ["contexte_en: bold", "contexte_fr: flou", "contexte_fr: timide", "contexte_fr: vague"]
    assert T.JUDGEMENTS


def test_without(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, v string")
    assert rows(without(a, a.where("id = 2").select("id"), "id")) == [(1, "x"), (None, "z")]
    assert rows(without(a, a.limit(0).select("id"), "id"), "v") == [("x",), ("y",), ("z",)]
