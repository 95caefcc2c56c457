"""What the published pages hold: alternates, sitemap, labels, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Locales (the first is the default) and the segment of a person's page.
LOCALES = ["fr", "en"]
PERSON_SEGMENT = {"fr": "personne", "en": "person"}
AXIS_LABELS = {
    "regulation": ("Régulation", "Regulation"), "souverainete": ("Souveraineté & infra", "Sovereignty & infra"), "environnement": ("Environnement & ressources", "Environment & resources"),
    "emploi": ("Emploi", "Jobs"), "formation": ("Éducation & formation", "Education & training"), "services-publics": ("Services publics", "Public services"),
    "surveillance-libertes": ("Surveillance & libertés", "Surveillance & liberties"), "securite": ("Sécurité", "Security"), "defense": ("Défense", "Defence"), "peur": ("Peur", "Fear"), "financement": ("Financement", "Funding"),
}
TIER_LABELS = {"1": ("ses propres mots", "their own words"), "2": ("parti ou entourage", "party or staff"), "3": ("presse", "press")}


def locales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, PERSON_SEGMENT[x], i) for i, x in enumerate(LOCALES)], "locale string, segment string, ordinal int")


def person_pages(people: DataFrame) -> DataFrame:
    """(slug, locale, path): each person's page in each locale."""
    loc = F.broadcast(locales(people.sparkSession))
    return people.select("slug").distinct().crossJoin(loc).select("slug", "locale", F.concat(F.lit("/"), "locale", F.lit("/"), "segment", F.lit("/"), "slug", F.lit("/")).alias("path"))


def sitemap(pages: DataFrame, base: str) -> DataFrame:
    """(loc, hreflang, href): each page's alternates and its default."""
    loc = F.concat(F.lit(base), F.col("path"))
    a = pages.select("slug", loc.alias("loc"))
    b = pages.select("slug", F.col("locale").alias("hreflang"), loc.alias("href"))
    own = a.join(b, "slug").select("loc", "hreflang", "href")
    default = a.join(b.where(F.col("hreflang") == LOCALES[0]), "slug").select("loc", F.lit("x-default").alias("hreflang"), "href")
    return own.unionByName(default)


def labels(spark: SparkSession, table: dict[str, tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(k, x, v[i], n) for n, (k, v) in enumerate(table.items()) for i, x in enumerate(LOCALES)], "key string, locale string, label string, ordinal int")


def labelled(rows: DataFrame, key: str, table: dict[str, tuple[str, str]], locale: str) -> DataFrame:
    """Rows with the label of `key`; an unknown key keeps itself."""
    dim = labels(rows.sparkSession, table).where(F.col("locale") == locale).select(F.col("key").alias(key), "label")
    return rows.join(F.broadcast(dim), key, "left").withColumn("label", F.coalesce("label", F.col(key)))


def manifest(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, locale, n_claims, content_key): one row per person page; the key changes with the claims that the page shows.

    The key is a sum over hashes of the distinct claims, so it is combined before the shuffle like any sum.
    """
    part = F.conv(F.substring(F.sha2("claim_id", 256), 1, 8), 16, 10).cast("long")
    per = rows.select(F.col("person").alias("slug"), "claim_id").distinct().groupBy("slug").agg(F.count("*").alias("n"), F.sum(part).alias("sum"))
    return pages.join(per, "slug", "left").select("path", "locale", F.coalesce("n", F.lit(0)).alias("n_claims"), F.coalesce("sum", F.lit(0)).alias("content_key"))
