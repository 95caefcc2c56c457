"""Look-alike characters and wrong encodings: round trips over text of known origin."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest

from quillon.llm import encodings as E
from quillon.llm import lookalikes as L

CLEAN = """La présidente du conseil défend l'été prochain une expérimentation à côté du lycée, après l'échec constaté.
« Nous créerons 3 400 stages pour la sécurité des hôpitaux », résume Élie Bondurieux – où ça ?
À mi-mandat, l’association réclame très tôt un contrôle humain ; le cœur du rôle reste à écrire."""
DOCS = "doc_id long, text string, changed string, id int"


@pytest.fixture(scope="module")
def counts(spark):
    df = spark.createDataFrame([(CLEAN,), ("данные и слово",), ("λόγος και λέξη",), (None,), ("",)], "text string")
    return L.pair_counts(df)


def test_pair_counts_cover_all_text(spark, counts):
    assert counts[0, ord("l")] == len(re.findall(r"(?<![^\W\d_])l", CLEAN.lower())) and counts[ord("l"), ord("a")] == CLEAN.lower().count("la")


def disguise(rnd, text):
    back = {v: k for k, v in L.LOOK.items() if unicodedata.normalize("NFKC", k) == k}
    out = []
    for w in text.split(" "):
        kind = rnd.randrange(6)
        at = [i for i, c in enumerate(w) if c in back]
        if kind == 0 and len(w) > 3 and at and len(at) < sum(map(str.isalpha, w)):
            i = rnd.choice(at)
            w = w[:i] + back[w[i]] + w[i + 1 :]
        elif kind == 1:
            w = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in w)
        elif kind == 2:
            w = unicodedata.normalize("NFD", w)
        elif kind == 3 and len(w) > 1:
            w = w[:1] + rnd.choice("​‌­﻿⁠‎") + w[1:]
        out.append(w)
    return rnd.choice(["\u00a0", "\u2009", " "]).join(out)


def test_round_trip(counts):
    rnd = random.Random(4)
    lattice = L.Lattice(counts)
    good = 0
    for _ in range(60):
        dirty = disguise(rnd, CLEAN)
        good += lattice.clean(dirty) == CLEAN
    assert good >= 57


def test_what_stays(counts):
    lattice = L.Lattice(counts)
    for t in (CLEAN, "данные", "λόγος et π", "« cité » – l’été", "tab\tligne\n", "", "São Belmirão", "œuvre Æ"):
        assert lattice.clean(t) == t


def test_consistent_table(spark, counts):
    rows = [(1, "a\u00a0b", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "net", "x", 1), (5, "dаns", "x", 1), (5, "dаns", "x", 1), (None, "dаns", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in L.consistent(df, "doc_id", "text", counts).collect()), key=repr)
    assert got == [(1, "a b", True), (2, None, False), (3, "", False), (4, "net", False), (5, "dans", True), (5, "dans", True)]
    assert L.consistent(df, "doc_id", "text", counts, True).count() == 3
    assert L.consistent(df.limit(0), "doc_id", "text", counts).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return E.train(spark.createDataFrame([(1, CLEAN, "", 0), (2, None, "", 0)], DOCS))


CHAINS = [(("utf-8", w),) for w in ("cp1252", "latin-1", "iso8859-15", "cp1251", "cp437", "cp850", "mac_roman")] + [(("utf-8", "cp1252"),) * 2, (("utf-8", "latin-1"), ("utf-8", "cp1252")), (("cp1252", "mac_roman"),), (("cp1252", "cp850"),)]


@pytest.mark.parametrize("chain", CHAINS, ids=str)
def test_chains_are_found_and_inverted(model, chain):
    text = CLEAN.replace("–", "-").replace("’", "'").replace("œ", "oe")
    bad = E.garble(text, chain)
    got, found = E.Detector(model).repair(bad)
    assert found
    words = list(zip(text.split(), got.replace("\xa0", " ").split()))
    # single-byte marks such as quotation marks are not told from signs of their own
    marks = chain[0][0] != "utf-8"
    wrong = [(a, b) for a, b in words if a != b and not (marks and not any(ch.isalpha() for ch in a))]
    assert len(wrong) <= (3 if marks else 0), wrong


def test_clean_text_is_left(model):
    d = E.Detector(model)
    for t in (CLEAN, CLEAN.upper(), " ".join(E.NAMES), "São Belmirão et João", "dаns un mοt", "ｌａｒｇｅ", "a\u00a0b", "é", "", "µ½²"):
        assert d.repair(t) == (t, False), t


def test_lost_characters_are_found(model):
    assert E.Detector(model).repair("pr�s") == ("pr�s", True)


def test_garbled_table(spark, model):
    bad = E.garble("réglé", CHAINS[0])
    df = spark.createDataFrame([(1, bad, "", 0), (1, bad, "", 0), (2, "réglé", "", 0), (3, None, "", 0), (4, "", "", 0), (5, "a " * 200_000 + bad, "", 0), (None, bad, "", 0)], DOCS)
    assert sorted(r[0] for r in E.garbled(df, model).collect()) == [1, 5]
    out = {r["doc_id"]: (r["text"], r["garbled"]) for r in E.restored(df, model).collect()}
    assert out[1] == ("réglé", True) and out[3] == (None, False) and out[4] == ("", False)
    assert E.garbled(df.limit(0), model).count() == 0
    E.train(df.limit(0))


def test_mixed_words_of_other_scripts(spark):
    russian = "москва и правительство россии в республики города россия москва правительство республика мы все"
    df = spark.createDataFrame([(CLEAN,), (russian,), (russian.title(),), (russian,)], "text string")
    lattice = L.Lattice(L.pair_counts(df))
    # Latin letters among Cyrillic ones become Cyrillic, Cyrillic ones among Latin become Latin
    for mixed, want in (("Mосква", "Москва"), ("правительcтво", "правительство"), ("Pоссии", "России"), ("pеспублики", "республики"), ("prоjet", "projet"), ("соllègе", "collège")):
        assert lattice.judged(mixed) == (want, True), mixed
    assert lattice.judged("Москва и projet") == ("Москва и projet", False)
    # a mixed word is found whatever comes out of it
    rows = spark.createDataFrame([(1, "Mосква", "", 0), (2, "qж", "", 0), (3, "Москва", "", 0)], DOCS)
    got = {r["id"] for r in L.consistent(rows.drop("id"), "doc_id", "text", lattice.counts, True).collect()}
    assert got == {1}


def test_foreign_names_are_not_garbled():
    m = E.Model(re.findall(E.TOKEN, CLEAN))
    d = E.Detector(m)
    for name in ("Ångström", "Belmirão", "Sørensen", "Kovač", "Lindström", "Núñez", "Gonçalo", "Bjørn"):
        assert d.judge(name) is None, name
    assert d.judge("Ã©tÃ©") == "été"
