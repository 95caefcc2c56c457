"""Readers of landed files and the stream of first sightings."""

from __future__ import annotations

import datetime as dt


from quillon.sources import landed
from quillon.streaming.seen import run_available

SITTING = """<?xml version="1.0"?><c:compteRendu xmlns:c="http://records.example"><c:uid>S1</c:uid><c:metadonnees><c:dateSeance>20260301090000</c:dateSeance><c:dateSeanceJour>dimanche 1 mars</c:dateSeanceJour></c:metadonnees>
<c:point><c:paragraphe id_acteur="PA1" roledebat="orateur"><c:texte>Un <c:italique>premier</c:italique>
 mot.</c:texte></c:paragraphe><c:paragraphe id_acteur="PA9" roledebat="president"><c:texte>La parole.</c:texte></c:paragraphe>
<c:paragraphe id_acteur="PA0"><c:texte>Bruit</c:texte></c:paragraphe><c:paragraphe><c:texte>Sans voix</c:texte></c:paragraphe><c:paragraphe id_acteur="PA1"><c:texte>Un second.</c:texte></c:paragraphe></c:point></c:compteRendu>"""


def test_sittings(spark):
    f = spark.createDataFrame([(bytearray(SITTING.encode()),), (bytearray(b"<broken"),), (None,)], "content binary")
    s = landed.speeches(landed.sittings(f))
    assert [tuple(r) for r in s.collect()] == [("S1", dt.date(2026, 3, 1), "Séance du dimanche 1 mars", "PA1", "Un premier mot.\n\nUn second.")]
    dated = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 5, 1),), (None,)], "sitting_date date")
    assert landed.since(dated, "2026-02-01").count() == 2


def test_feed_items(spark, tmp_path):
    items = "".join(f"<item><title>{'' if i == 1 else f't{i}'}</title><link>l{i}</link><pubDate>d</pubDate></item>" for i in range(25))
    (tmp_path / "a.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><chan")
    got = landed.feed_items(spark, str(tmp_path / "*.xml"), 20).orderBy("pos").collect()
    assert len(got) == 20 and got[1]["title"] == "(untitled)" and got[0]["link"] == "l0"


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://x.example/a </loc><lastmod>2026-01-02T00:00:00Z</lastmod></url></urlset>")
    assert [tuple(r) for r in landed.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()] == [("https://x.example/a", dt.date(2026, 1, 2))]


def test_listing_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("u\t20260102\tun\ttitre",), ("v\tNA\tNA",), ("",)], "value string")
    assert [tuple(r) for r in landed.video_listing(rows).collect()] == [("u", dt.date(2026, 1, 2), "un\ttitre"), ("v", None, None)]
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.bin").write_bytes(b"<html>")
    assert sorted(r["format"] for r in landed.captures(spark, str(tmp_path / "*.bin")).collect()) == ["html", "pdf"]
    (tmp_path / "c.vtt").write_text("WEBVTT\n\nx")
    assert landed.caption_files(spark, str(tmp_path / "*.vtt")).first()["text"] == "WEBVTT\n\nx"


def test_artifacts(spark, tmp_path):
    (tmp_path / "b7.requests.jsonl").write_text('{"custom_id":"a:0","text_sha256":"h"}\n')
    got = landed.artifacts(spark, str(tmp_path / "*.requests.jsonl"), "custom_id string, text_sha256 string").collect()
    assert [tuple(r) for r in got] == [("a:0", "h", "b7")]
    out = spark.createDataFrame([("b1", "x"), ("b2", "y")], "batch_id string, v string")
    landed.write_artifacts(out, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    landed.write_export(out.orderBy("v"), str(tmp_path / "rec"))
    assert spark.read.json(str(tmp_path / "rec")).count() == 2


def test_stream_of_first_sightings(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("a", dt.datetime(2026, 1, 2)), ("b", dt.datetime(2026, 1, 1))], "url_hash string, fetched_at timestamp")
    df.write.parquet(src)
    run_available(spark, src, df.schema, dst, cp, "url_hash", "fetched_at")
    assert spark.read.parquet(dst).count() == 2
    df.unionByName(spark.createDataFrame([("c", dt.datetime(2026, 1, 3))], df.schema)).write.mode("append").parquet(src)
    run_available(spark, src, df.schema, dst, cp, "url_hash", "fetched_at")
    assert sorted(r[0] for r in spark.read.parquet(dst).select("url_hash").collect()) == ["a", "b", "c"]


def test_catalogue_matches_its_sql(spark):
    """Every query beside its SQL on the smallest tables, where they are there."""
    import os
    from collections import Counter

    import duckdb
    import pytest

    from quillon.plans import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v

    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, d)
        cols = sorted(df.columns)
        ours = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
        cur = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})")
        assert ours == Counter(tuple(plain(v) for v in r) for r in cur.fetchall()), name


def test_stream_never_forgets_and_takes_late_rows(spark, tmp_path):
    src, dst, cp = (str(tmp_path / x) for x in ("src", "dst", "cp"))
    schema = "url_hash string, fetched_at timestamp"
    batches = [[("a", dt.datetime(2024, 10, 1))], [("new", dt.datetime(2027, 9, 1))], [("late", dt.datetime(2024, 11, 1))], [("a", dt.datetime(2027, 9, 2)), ("b", dt.datetime(2027, 9, 3)), ("b", dt.datetime(2027, 9, 2))]]
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(src)
        run_available(spark, src, df.schema, dst, cp, "url_hash", "fetched_at")
    got = sorted(tuple(r) for r in spark.read.parquet(dst).select("url_hash", "fetched_at").collect())
    assert got == [("a", batches[0][0][1]), ("b", dt.datetime(2027, 9, 2)), ("late", batches[2][0][1]), ("new", batches[1][0][1])]
