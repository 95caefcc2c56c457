"""Readers of files as they were fetched; network access is not part of the engine."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T

FEED_ITEM = "title STRING, link STRING, pubDate STRING, published STRING"


def feed_items(spark: SparkSession, path: str, max_items: int = 20) -> DataFrame:
    """(file, pos, title, link, published): the first items of each landed RSS file; a broken file gives none."""
    x = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(FEED_ITEM).load(path)
    x = x.withColumn("file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id()).where(F.col("link").isNotNull())
    pos = F.row_number().over(W.partitionBy("file").orderBy("_at"))
    return x.withColumn("pos", pos).where(F.col("pos") <= max_items).select("file", "pos", T.blank_to(F.col("title"), "(untitled)").alias("title"), "link", F.coalesce("published", "pubDate").alias("published"))


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of landed sitemaps."""
    return spark.read.format("xml").option("rowTag", "url").option("mode", "PERMISSIVE").schema("loc STRING, lastmod STRING").load(path).where(F.col("loc").isNotNull()).select(T.strip(F.col("loc")).alias("loc"), T.leading_date(F.col("lastmod")).alias("lastmod"))


SPOKEN = "uid string, date_text string, day_text string, actor string, role string, pos int, said string"


def _plain(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


def _spoken_rows(xml: bytes) -> list[tuple]:
    """Each paragraph of one sitting record; a malformed record has none."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    head: dict[str, str] = {}
    out = []
    for node in root.iter():
        name = _plain(node.tag)
        if name in ("uid", "dateSeance", "dateSeanceJour"):
            head.setdefault(name, (node.text or "").strip())
        elif name == "paragraphe":
            body = next((x for x in node if _plain(x.tag) == "texte"), None)
            if body is not None:
                out.append((node.get("id_acteur"), node.get("roledebat"), len(out), " ".join("".join(body.itertext()).split())))
    return [(head.get("uid", ""), head.get("dateSeance"), head.get("dateSeanceJour"), *x) for x in out]


def sittings(files: DataFrame, content: str = "content") -> DataFrame:
    """The paragraphs of sitting records (binary column `content`), as they stand; see SPOKEN."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [r for x in pdf[content] if x is not None for r in _spoken_rows(bytes(x))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPOKEN.split(", ")])

    return files.select(content).mapInPandas(run, SPOKEN)


def speeches(spoken: DataFrame) -> DataFrame:
    """(uid, sitting_date, title, actor, text): each speaker's paragraphs of a sitting in order, without the chair and unknown actors."""
    ok = spoken.where(F.col("actor").isNotNull() & ~F.col("actor").isin("", "PA0") & (F.coalesce("role", F.lit("")) != "president") & (F.col("said") != ""))
    parts = F.array_sort(F.collect_list(F.struct("pos", "said")))
    g = ok.groupBy("uid", "actor").agg(parts.alias("parts"), F.first("date_text").alias("d"), F.first("day_text").alias("j"))
    title = F.when(F.coalesce("j", F.lit("")) != "", F.concat(F.lit("Séance du "), F.col("j"))).otherwise(F.col("uid"))
    return g.select("uid", T.leading_date(F.col("d")).alias("sitting_date"), title.alias("title"), "actor", F.array_join(F.transform("parts", lambda x: x["said"]), "\n\n").alias("text"))


def since(rows: DataFrame, day: str | None, date_col: str = "sitting_date") -> DataFrame:
    """Rows from `day` on; undated rows stay."""
    return rows if day is None else rows.where(F.col(date_col).isNull() | (F.col(date_col) >= F.lit(day).cast("date")))


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): caption files as a whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, content): raw captures, told apart by their first bytes."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), T.capture_format(F.col("content")).alias("format"), "content")


def video_listing(lines: DataFrame, text: str = "value") -> DataFrame:
    """(url, day, title) of listing lines url<TAB>date<TAB>title; the title NA is none."""
    parts = F.split(F.col(text), "\t", 3)
    return lines.select(F.get(parts, F.lit(0)).alias("url"), T.leading_date(F.get(parts, F.lit(1))).alias("day"), F.nullif(F.get(parts, F.lit(2)), F.lit("NA")).alias("title")).where("url <> ''")


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSONL artifacts, with the batch that their file is named after."""
    x = spark.read.schema(schema).json(path)
    return x.withColumn("batch_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.(?:requests|responses|expired)\.jsonl", 1))


def write_artifacts(rows: DataFrame, path: str) -> None:
    """One folder a batch, in JSON lines."""
    rows.write.mode("append").partitionBy("batch_id").json(path)


def write_export(rows: DataFrame, path: str) -> None:
    """The published record as ordered JSON lines."""
    rows.write.mode("overwrite").json(path)
