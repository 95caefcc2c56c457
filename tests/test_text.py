"""Text, identity and date expressions against plain Python."""

from __future__ import annotations

import datetime
import hashlib
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.chunks import chunks, spans


def one(spark, expr, *values, schema="a string, b string"):
    names = [x.split()[0] for x in schema.split(", ")]
    row = dict(zip(names, [*values, *[None] * (len(names) - len(values))]))
    return spark.createDataFrame([tuple(row[n] for n in names)], schema).select(expr.alias("x")).first()["x"]


def test_strip_and_collapse(spark):
    assert one(spark, T.strip(F.col("a")), "  a b \n") == "a b"
    assert one(spark, T.collapse(F.col("a")), " a \n b\x1cc ") == "a b c"
    assert one(spark, T.collapse(F.col("a")), None) is None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=20))
def test_layout_free_is_python_split(spark, texts):
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string").select("i", T.layout_free(F.col("a")).alias("x")).orderBy("i").collect()]
    assert got == [" ".join(unicodedata.normalize("NFC", t).split()) for t in texts]


def test_reader_form(spark):
    assert one(spark, T.reader_form(F.col("a")), "L’ＩA  STRASSE ß") == "l'ia strasse ss"


def test_word_count_boundary(spark):
    assert one(spark, T.word_count(F.col("a")), " ".join(["mot"] * 40)) == 40
    assert one(spark, T.word_count(F.col("a")), " \n ") == 0


def test_flatten_pages(spark):
    assert one(spark, T.flatten_pages(F.col("a")), "un\ndeux  trois\n \n\n« quatre »\nsur-\namortissement\n\n  \n") == "un deux trois\n\n« quatre » sur- amortissement"


def test_keys(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert one(spark, T.document_key(F.col("a"), F.col("b")), "u", None) == h("u")
    assert one(spark, T.document_key(F.col("a"), F.col("b")), "u", "f") == h("u\nf")
    assert one(spark, T.claim_key(F.col("a"), F.col("b")), "u", "qé") == h("u\nqé")
    assert one(spark, T.source_key(F.lit("p"), F.lit("rss"), F.col("a")), None) == "p:rss:" + hashlib.sha1(b"").hexdigest()[:8]


def test_leading_date(spark):
    for text, want in (("2026-03-01T10", datetime.date(2026, 3, 1)), ("20260301", datetime.date(2026, 3, 1)), ("2026-13-01", None), (" 2026-03-01", None), ("Mon, 01 Mar 2026", None), (None, None)):
        assert one(spark, T.leading_date(F.col("a")), text) == want, text


def test_cited_at(spark):
    s = "a string, k string, n int"
    e = T.cited_at(F.col("a"), F.col("k"), F.col("n"))
    assert one(spark, e, "https://v.example/1", "video", 5, schema=s) == "https://v.example/1?t=5"
    assert one(spark, e, "https://v.example/1?a=b", "video", 0, schema=s) == "https://v.example/1?a=b&t=0"
    assert one(spark, e, "https://v.example/1", "vote", 5, schema=s) == "https://v.example/1"


def test_host(spark):
    assert one(spark, T.host(F.col("a")), "https://u@h.example:80/x?y#z") == "u@h.example:80"
    assert one(spark, T.host(F.col("a")), "no address") == "no address"


def test_on_subject(spark):
    for text, want in (
        ("L'IA avance", True), ("MIA n'est pas là", False), ("le NUMÉRIQUE et les données", True), ("données, données et Données", False), ("des data centers", True),
        ("la reconnaissance  faciale", True), ("rien", False), ("le cloud et un robot", True),
    ):
        assert one(spark, T.on_subject(F.col("a")), text) is want, text


def test_capture(spark):
    for url, want in (("https://a.example/web/20260101000000/https://x", True), ("https://a.example/web/2026/https://x", False), (None, False), ("", False), ("x https://a.example/web/20260101000000/", False)):
        assert one(spark, T.is_capture(F.col("a")), url) is want


def test_capture_format(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.7 x"),), (bytearray(b"<html>"),)], "c binary")
    assert [r[0] for r in df.select(T.capture_format(F.col("c"))).collect()] == ["pdf", "html"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(20, 60))
def test_chunks_cover_the_text(text, size):
    got = spans(text, size, 5)
    assert all(0 < len(c) <= size for c in got)
    at = 0
    stripped = text.strip()
    for c in got:
        i = stripped.find(c, max(0, at - size))
        assert i >= 0
        at = i + len(c)
    assert "".join("".join(got).split())[:1] == "".join(stripped.split())[:1]
    # no character but white space is lost
    seen, pos = [False] * len(stripped), 0
    for c in got:
        i = stripped.find(c, max(0, pos - 5 - 2))
        i = i if i >= 0 else stripped.find(c)
        for k in range(i, i + len(c)):
            seen[k] = True
        pos = i + len(c)


def test_chunk_rules(spark):
    text = "a" * 3500 + "\n\n" + "b" * 1000 + ". " + "c" * 4000
    got = spans(text)
    assert got[0] == "a" * 3500  # the blank line goes before the full stop
    assert spans("x" * 6000) == ["x" * 6000] and len(spans("x" * 6001)) == 2
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "court")], "id int, text string")
    assert [tuple(r) for r in chunks(df, ["id"]).collect()] == [(3, 0, "court")]
