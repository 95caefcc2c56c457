"""Queries over the stored tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.chunks import chunks
from quillon.operators import extraction, gates, positions, routing, site, store, transcripts
from quillon.session import cut, load, ship
from quillon.skew import join_cells

#: The captures of the stored tables.
CAPTURE = r"^https://archive\.example/web/\d{14}/"
#: Two words that the stored texts hold, for the subject filter over them.
STRONG = r"(?iu)algorithm|reconnaissance\s+des\s+visages|centres\s+de\s+donn[ée]es"
WEAK = r"(?iu)(\bnum[ée]rique|\bdonn[ée]es|automatique|\brobot|\bcalcul|agents\s+conversationnels)"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# -- sources -----------------------------------------------------------------------------------------


@_query("""
WITH r AS (SELECT doc_id, source_id, url, title, doc_date, text,
                  row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, doc_id DESC) AS pos FROM documents WHERE kind = 'rss')
SELECT doc_id, source_id, url, title, doc_date, CAST(length(text) AS INTEGER) AS n_chars FROM r WHERE pos <= 20 AND length(text) >= 400""")
def o01_feed_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("kind = 'rss'").select("doc_id", "source_id", "url", "title", "doc_date", "fetched_at", F.length("text").alias("n_chars"))
    pos = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("doc_id")))
    return rows.withColumn("pos", pos).where((F.col("pos") <= 20) & (F.col("n_chars") >= 400)).select("doc_id", "source_id", "url", "title", "doc_date", "n_chars")


_STRONG_SQL = r"(?i)algorithm|reconnaissance\s+des\s+visages|centres\s+de\s+donn[ée]es"
_WEAK_SQL = r"(?i)(?:(?:^|[^\p{L}\p{N}_])(num[ée]rique|donn[ée]es|robot|calcul)|(automatique|agents\s+conversationnels))"
_SUBJECT_SQL = f"""(regexp_matches(text, '{_STRONG_SQL}') OR len(list_distinct(list_transform(regexp_extract_all(text, '{_WEAK_SQL}'), lambda x: regexp_replace(lower(x), '^[^\\p{{L}}\\p{{N}}_]', '')))) >= 2)"""


@_query(f"SELECT doc_id, url, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE kind = 'site' AND length(text) >= 400 AND {_SUBJECT_SQL}")
def o03_site_documents(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").where((F.col("kind") == "site") & (F.length(t) >= 400)).where(T.on_subject(t, STRONG, WEAK)).select("doc_id", "url", F.length(t).alias("n_chars"))


@_query("""
WITH s AS (SELECT unnest(sources) AS s FROM people), l AS (SELECT s.source_id AS source_id, max(s.label) AS label FROM s GROUP BY ALL)
SELECT doc_id, coalesce(nullif(label, ''), title) AS title FROM documents LEFT JOIN l USING (source_id) WHERE kind = 'page' AND length(text) >= 400""")
def o04_page_documents(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "people").select(F.explode("sources").alias("s")).groupBy(F.col("s.source_id").alias("source_id")).agg(F.max("s.label").alias("label"))
    pages = load(spark, d, "documents").where((F.col("kind") == "page") & (F.length("text") >= 400)).select("doc_id", "source_id", "title")
    return pages.join(labels, "source_id", "left").select("doc_id", F.coalesce(F.nullif("label", F.lit("")), "title").alias("title"))


@_query("""
WITH s AS (SELECT unnest(sources) AS s FROM people), k AS (SELECT s.source_id AS source_id, max(s.speakers) AS speakers FROM s GROUP BY ALL)
SELECT doc_id, CASE WHEN speakers = 'multi' THEN 'lead' ELSE 'document' END AS route FROM documents LEFT JOIN k USING (source_id) WHERE kind = 'video'""")
def o05_video_routes(spark: SparkSession, d: str) -> DataFrame:
    voices = load(spark, d, "people").select(F.explode("sources").alias("s")).groupBy(F.col("s.source_id").alias("source_id")).agg(F.max("s.speakers").alias("speakers"))
    videos = load(spark, d, "documents").where("kind = 'video'").select("doc_id", "source_id")
    return videos.join(voices, "source_id", "left").select("doc_id", F.when(F.col("speakers") == "multi", "lead").otherwise("document").alias("route"))


@_query("SELECT lead_no, coalesce(nullif(title, ''), '(untitled)') AS title, url, publisher, lead_date FROM leads")
def o07_news_leads(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "leads").select("lead_no", T.blank_to(F.col("title"), "(untitled)").alias("title"), "url", "publisher", "lead_date")


@_query("""
WITH t AS (SELECT DISTINCT video_id, turn_no, start_s, end_s FROM turns WHERE end_s > start_s),
p AS (SELECT *, unnest(range(0, CAST(ceil((end_s - start_s) / 28.0::DOUBLE) AS INTEGER))) AS part FROM t)
SELECT video_id, turn_no, CAST(part AS INTEGER) AS part, round(start_s + part * 28, 3) AS start_s, round(least(start_s + part * 28 + 28, end_s), 3) AS end_s FROM p""")
def o18_segments(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "turns").select("video_id", "turn_no", "start_s", "end_s").distinct()
    return transcripts.segments(t).select("video_id", "turn_no", "part", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


# -- store -------------------------------------------------------------------------------------------


@_query("""SELECT url_hash, person, source_id, kind, tier, url, title, doc_date, CAST(length(text) AS INTEGER) AS chars,
CASE WHEN archive_url IS NOT NULL THEN 1 ELSE 0 END AS archived, CAST(tier_confirmed AS INTEGER) AS confirmed FROM documents""")
def o20_document_view(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("url_hash", "person", "source_id", "kind", "tier", "url", "title", "doc_date", F.length("text").alias("chars"), F.col("archive_url").isNotNull().cast("int").alias("archived"), F.col("tier_confirmed").cast("int").alias("confirmed"))


@_query("""SELECT record_no, CASE WHEN json_valid(payload) THEN payload ->> '$.axis' END AS axis, CASE WHEN json_valid(payload) THEN payload ->> '$.person' END AS person FROM claim_payloads""")
def o20_json_unpack(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "claim_payloads").select("record_no", F.try_parse_json("payload").alias("v"))
    return v.select("record_no", F.try_variant_get("v", "$.axis", "string").alias("axis"), F.try_variant_get("v", "$.person", "string").alias("person"))


@_query("SELECT person, source_id, title, url, publisher, lead_date, reason FROM leads")
def o21_lead_view(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "leads").select("person", "source_id", "title", "url", "publisher", "lead_date", "reason")


@_query("""SELECT claim_id, person, axis, claim_type, claim_date, quote_fr, source_url, CASE WHEN archive_url IS NOT NULL THEN 1 ELSE 0 END AS archived, timestamp_s, status FROM claims""")
def o22_claim_view(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "claims").select("claim_id", "person", "axis", "claim_type", "claim_date", "quote_fr", "source_url", F.col("archive_url").isNotNull().cast("int").alias("archived"), "timestamp_s", "status")


@_query("SELECT source_id, count(*) AS n_runs, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(kept) AS BIGINT) AS kept, epoch_us(max(run_at)) AS last_run_us FROM source_runs GROUP BY ALL")
def o23_source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return store.source_rollup(load(spark, d, "source_runs")).select("source_id", "n_runs", "fetched", "kept", F.unix_micros("last_run").alias("last_run_us"))


@_query("""SELECT url_hash, doc_id, person, source_id FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY fetched_at DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def o24_upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("url_hash", "doc_id", "person", "source_id", "fetched_at")
    return store.latest(rows, ["url_hash"], ["fetched_at", "doc_id"]).select("url_hash", "doc_id", "person", "source_id")


@_query("""SELECT url, person, lead_no, title FROM (SELECT *, row_number() OVER (PARTITION BY url, person ORDER BY fetched_at DESC, lead_no DESC) AS rn FROM leads) WHERE rn = 1""")
def o24_upsert_leads(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "leads").select("url", "person", "lead_no", "title", "fetched_at")
    return store.latest(rows, ["url", "person"], ["fetched_at", "lead_no"]).drop("fetched_at")


@_query("""SELECT claim_id, claim_no, status, quote_fr FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY last_verified DESC, claim_no DESC) AS rn FROM claims) WHERE rn = 1""")
def o24_upsert_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "claims").select("claim_id", "claim_no", "status", "quote_fr", "last_verified")
    return store.latest(rows, ["claim_id"], ["last_verified", "claim_no"]).drop("last_verified")


@_query("""SELECT url_hash, doc_id, epoch_us(fetched_at) AS fetched_us FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY fetched_at, doc_id) AS rn FROM documents) WHERE rn = 1""")
def o25_seen_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("url_hash", "doc_id", "fetched_at")
    return store.earliest(rows, ["url_hash"], ["fetched_at", "doc_id"]).select("url_hash", "doc_id", F.unix_micros("fetched_at").alias("fetched_us"))


@_query("""
WITH once AS (SELECT source_id, seq, max(fetched) AS fetched FROM source_runs GROUP BY ALL),
     last AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM once)
SELECT source_id FROM last WHERE rn <= 3 GROUP BY ALL HAVING count(*) >= 3 AND max(fetched) = 0""")
def o26_dead_sources(spark: SparkSession, d: str) -> DataFrame:
    return store.silent_sources(load(spark, d, "source_runs"))


@_query("SELECT DISTINCT source_id, seq, epoch_us(run_at) AS run_us, fetched, kept FROM source_runs")
def o27_run_log(spark: SparkSession, d: str) -> DataFrame:
    """The log without the rows that were stored twice."""
    return load(spark, d, "source_runs").select("source_id", "seq", F.unix_micros("run_at").alias("run_us"), "fetched", "kept").distinct()


@_query("SELECT doc_id, url_hash, epoch_us(fetched_at) AS fetched_us FROM documents ORDER BY fetched_at, doc_id")
def o28_ordered_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "url_hash", F.unix_micros("fetched_at").alias("fetched_us")).orderBy("fetched_us", "doc_id")


@_query("SELECT person, claim_date, claim_id, claim_no FROM claims ORDER BY person, coalesce(CAST(claim_date AS VARCHAR), ''), claim_id")
def o30_export_order(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "claims").select("person", "claim_date", "claim_id", "claim_no").orderBy(*store.export_order())


@_query("""
WITH old AS (SELECT claim_id, claim_no, status FROM claims WHERE status <> 'pending'),
     new AS (SELECT claim_id, min(claim_no) AS claim_no FROM claims WHERE status = 'pending' AND claim_id NOT IN (SELECT claim_id FROM old) GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT claim_id, claim_no, 'pending' FROM new""")
def o31_merge_claims(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed claims are the stored record, pending ones are new."""
    rows = load(spark, d, "claims").select("claim_id", "claim_no", "status")
    return store.merge(rows.where("status <> 'pending'"), rows.where("status = 'pending'"), "claim_id", ["claim_no"])


@_query("SELECT person, axis, claim_date, claim_id, claim_no FROM claims ORDER BY person, axis, coalesce(claim_date, DATE '0001-01-01'), claim_id")
def o35_review_order(spark: SparkSession, d: str) -> DataFrame:
    day = F.coalesce("claim_date", F.lit("0001-01-01").cast("date"))
    return load(spark, d, "claims").select("person", "axis", "claim_date", "claim_id", "claim_no").orderBy("person", "axis", day, "claim_id")


@_query("SELECT lead_no, url FROM leads WHERE url NOT IN (SELECT url FROM documents)")
def o36_sheet_todo(spark: SparkSession, d: str) -> DataFrame:
    """Leads whose page was not taken in yet."""
    return store.unseen(load(spark, d, "leads").select("lead_no", "url"), load(spark, d, "documents"), ["url"])


# -- routing -----------------------------------------------------------------------------------------


@_query("""
SELECT 'document' AS route, doc_id, title, CAST(NULL AS VARCHAR) AS reason FROM documents WHERE tier <> '3'
UNION ALL SELECT 'lead', doc_id, coalesce(nullif(title, ''), '(untitled)'), 'press: reporting, not the person''s own words' FROM documents WHERE tier = '3'""")
def o40_tier_route(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    kept = routing.kept_documents(docs).select(F.lit("document").alias("route"), "doc_id", "title", F.lit(None).cast("string").alias("reason"))
    press = docs.where(F.col("tier") == "3")
    leads = press.select(F.lit("lead").alias("route"), "doc_id", T.blank_to(F.col("title"), "(untitled)").alias("title"), F.lit(routing.PRESS).alias("reason"))
    return kept.unionByName(leads)


_NAMED_SQL = """
names AS (SELECT slug, lower(unnest(match_names)) AS name FROM people)
SELECT DISTINCT {no}, slug AS named_person FROM {table} JOIN names
ON CASE WHEN contains(lower({text}), name) THEN regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_replace(name, '([^\\p{{L}}\\p{{N}} ])', '\\\\\\1', 'g') || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END"""


@_query("WITH " + _NAMED_SQL.format(no="doc_id", table="documents", text="text"))
def o41_attribution(spark: SparkSession, d: str) -> DataFrame:
    return routing.attributed(load(spark, d, "documents").select("doc_id", "text"), F.col("text"), load(spark, d, "people")).select("doc_id", "named_person")


#: No title of the stored leads names a person: subjects stand in for people, with names that begin or hold others.
STAND_INS = {
    "sante": ["données de santé", "hôpitaux", "sécurité des hôpitaux"], "drones": ["drones", "drones de surveillance"], "ouverts": ["modèles ouverts"], "ruralite": ["collectivités rurales", "bibliothèques"],
    "emploi": ["emploi", "jeunes diplômés", "traducteurs"], "calcul": ["calcul intensif", "centres de données", "serveurs", "modèles"], "ecole": ["élèves", "orientation des élèves", "apprentissage"],
}
_STAND_INS_SQL = "people AS (SELECT * FROM (VALUES " + ", ".join("('{}', [{}])".format(k, ", ".join(f"'{n}'" for n in v)) for k, v in STAND_INS.items()) + ") t(slug, match_names))"


def _stand_ins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STAND_INS.items()), "slug string, match_names array<string>")


@_query("WITH " + _STAND_INS_SQL + "," + _NAMED_SQL.format(no="lead_no, url", table="leads", text="title"))
def o42_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Leads copied for each of STAND_INS that their title names; the others are dropped."""
    return routing.attributed(load(spark, d, "leads").select("lead_no", "url", "title"), F.col("title"), _stand_ins(spark)).select("lead_no", "url", "named_person")


@_query("""
WITH s AS (SELECT slug, unnest(sources) AS s FROM people)
SELECT slug, s.type AS type, s.url AS url, slug || ':' || s.type || ':' || substr(sha1(coalesce(s.url, '')), 1, 8) AS source_key FROM s""")
def o43_source_id(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "people").select("slug", F.explode("sources").alias("s"))
    return s.select("slug", F.col("s.type").alias("type"), F.col("s.url").alias("url"), T.source_key(F.col("slug"), F.col("s.type"), F.col("s.url")).alias("source_key"))


@_query("SELECT url_hash, doc_id, substr(sha256(CASE WHEN fingerprint IS NULL THEN url ELSE url || chr(10) || fingerprint END), 1, 16) AS document_key FROM documents")
def o43_document_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("url_hash", "doc_id", T.document_key(F.col("url"), F.col("fingerprint")).alias("document_key"))


@_query("SELECT claim_no, substr(sha256(source_url || chr(10) || quote_fr), 1, 16) AS claim_key FROM claims")
def o43_claim_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "claims").select("claim_no", T.claim_key(F.col("source_url"), F.col("quote_fr")).alias("claim_key"))


@_query("""
WITH x AS (SELECT record_no, CASE WHEN json_valid(payload) THEN payload ->> '$.date' END AS written FROM claim_payloads)
SELECT record_no, written, TRY_CAST(regexp_replace(nullif(regexp_extract(written, '^\\d{4}-?\\d{2}-?\\d{2}'), ''), '^(\\d{4})-?(\\d{2})-?(\\d{2})$', '\\1-\\2-\\3') AS DATE) AS day FROM x""")
def o45_parse_date(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "claim_payloads").select("record_no", F.try_variant_get(F.try_parse_json("payload"), "$.date", "string").alias("written"))
    return v.select("record_no", "written", T.leading_date(F.col("written")).alias("day"))


_FREE = r"trim(regexp_replace(nfc_normalize({}), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
_GOOD = r"regexp_matches(coalesce(archive_url, ''), '^https://archive\.example/web/\d{14}/')"


@_query(f"""
WITH need AS (SELECT claim_no, source_url, {_FREE.format("quote_fr")} AS quote FROM claims WHERE NOT {_GOOD}),
v AS (SELECT url, archive_url, 0 AS k, fetched_at, doc_id AS no, {_FREE.format("text")} AS body FROM documents WHERE {_GOOD}),
newest AS (SELECT url, arg_max(text, (fetched_at, doc_id)) AS text FROM documents GROUP BY ALL),
s AS (SELECT source_url AS url, archive_url, 1 AS k, TIMESTAMPTZ '9999-01-01' AS fetched_at, claim_no AS no, {_FREE.format("newest.text")} AS body FROM claims JOIN newest ON url = source_url WHERE {_GOOD}),
hit AS (SELECT claim_no, first(c.archive_url ORDER BY k, fetched_at, no) AS archive_url FROM need JOIN (SELECT * FROM v UNION ALL SELECT * FROM s) c ON c.url = need.source_url AND contains(c.body, quote) AND quote <> '' GROUP BY ALL),
ever AS (SELECT DISTINCT url FROM documents WHERE {_GOOD})
SELECT need.claim_no, hit.archive_url, hit.archive_url IS NOT NULL AS attached, hit.archive_url IS NULL AND ever.url IS NULL AS requested
FROM need LEFT JOIN hit ON hit.claim_no = need.claim_no LEFT JOIN ever ON ever.url = need.source_url""")
def o46_attach_archives(spark: SparkSession, d: str) -> DataFrame:
    return routing.attach_archives(load(spark, d, "claims"), load(spark, d, "documents"), CAPTURE)


# -- gates -------------------------------------------------------------------------------------------

_HITS = f"""
hits AS (SELECT claim_no, bool_or(contains(body, quote)) AS hit
  FROM (SELECT claim_no, source_url, {_FREE.format("quote_fr")} AS quote FROM claims) LEFT JOIN (SELECT DISTINCT url, {_FREE.format("text")} AS body FROM documents) ON url = source_url GROUP BY ALL)"""
_WORDS = "|".join(T.JUDGEMENTS)
_PROSE = " UNION ALL ".join(f"SELECT claim_no, '{f}' AS field, unnest(regexp_extract_all({f}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({_WORDS})', 1)) AS word FROM claims" for f in gates.PROSE)
_NEUTRALITY = f"SELECT 'neutrality' AS gate, claim_no, field || ': ' || lower(word) AS message, true AS fatal FROM ({_PROSE})"
_ARCHIVE = f"SELECT 'archive' AS gate, claim_no, CASE WHEN coalesce(archive_url, '') = '' THEN 'no capture' ELSE 'not a capture: ' || archive_url END AS message, true AS fatal FROM claims WHERE NOT {_GOOD}"
_LINT = f"""WITH {_HITS}
SELECT 'provenance' AS gate, claim_no, 'no stored version of the source' AS message, true AS fatal FROM hits WHERE hit IS NULL
UNION ALL SELECT 'quote', claim_no, 'the quote does not stand in the source', true FROM hits WHERE NOT hit
UNION ALL {_NEUTRALITY} UNION ALL {_ARCHIVE}"""


@_query(f"WITH {_HITS} SELECT claim_no, hit FROM hits")
def o50_quote_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates.quote_hits(load(spark, d, "claims"), load(spark, d, "documents"))


@_query(_LINT)
def o51_lint_union(spark: SparkSession, d: str) -> DataFrame:
    return gates.all_gates(load(spark, d, "claims"), load(spark, d, "documents"), CAPTURE)


#: The stored prose holds no judgement words; these beginnings of words it holds.
STAND_IN_WORDS = ["propos", "observ", "convent", "oblig", "étend", "clause", "figure", "scope", "stated", "with"]
_STAND_IN_SQL = " UNION ALL ".join(f"SELECT claim_no, '{f}' AS field, unnest(regexp_extract_all({f}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({'|'.join(STAND_IN_WORDS)})', 1)) AS word FROM claims" for f in gates.PROSE)


@_query(f"SELECT 'neutrality' AS gate, claim_no, field || ': ' || lower(word) AS message, true AS fatal FROM ({_STAND_IN_SQL})")
def o52_neutrality(spark: SparkSession, d: str) -> DataFrame:
    """The gate with STAND_IN_WORDS; o51 has it with the judgement words."""
    return gates.neutrality(load(spark, d, "claims"), STAND_IN_WORDS)


@_query(_ARCHIVE)
def o53_archive_shape(spark: SparkSession, d: str) -> DataFrame:
    return gates.archive(load(spark, d, "claims"), CAPTURE)


@_query(f"SELECT 'link-rot' AS gate, claim_no, 'no answer: ' || source_url AS message, NOT {_GOOD} AS fatal FROM claims WHERE source_url NOT IN (SELECT url FROM documents)")
def o54_link_severity(spark: SparkSession, d: str) -> DataFrame:
    """An address answers here if it is one of a stored document."""
    return gates.dead_links(load(spark, d, "claims"), load(spark, d, "documents").select("url"), CAPTURE)


@_query(f"SELECT count(*) FILTER (fatal) AS fatal, count(*) FILTER (NOT fatal) AS warnings, count(*) FILTER (fatal) > 0 AS blocked FROM ({_LINT})")
def o56_verdict(spark: SparkSession, d: str) -> DataFrame:
    return gates.verdict(gates.all_gates(load(spark, d, "claims"), load(spark, d, "documents"), CAPTURE))


# -- text --------------------------------------------------------------------------------------------


@_query()
def o60_pdf_flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = T.flatten_pages(F.col("text"))
    return load(spark, d, "documents").where("kind = 'pdf'").select("doc_id", flat.alias("text")).where("text <> ''")


@_query("""
WITH c AS (SELECT doc_id, i, cues[i].t AS t, trim(cues[i].line) AS line FROM (SELECT doc_id, cues, unnest(range(1, len(cues) + 1)) AS i FROM documents WHERE cues IS NOT NULL)),
f AS (SELECT * FROM c WHERE line <> ''), l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)
SELECT doc_id, CAST(t AS INTEGER) AS t, line FROM l WHERE before IS NULL OR before <> line""")
def o61_caption_cues(spark: SparkSession, d: str) -> DataFrame:
    """The cues of video documents, written as a caption file and read again."""
    t = lambda c: F.concat_ws(":", F.lpad((c["t"] / 3600).cast("int").cast("string"), 2, "0"), F.lpad(((c["t"] / 60).cast("int") % 60).cast("string"), 2, "0"), F.lpad((c["t"] % 60).cast("string"), 2, "0"))
    body = F.transform("cues", lambda c: F.concat(t(c), F.lit(".000 --> \n<c>"), c["line"], F.lit("</c>\n")))
    files = load(spark, d, "documents").where(F.col("cues").isNotNull()).select("doc_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(body, "\n")).alias("text"))
    return transcripts.caption_cues(files, "doc_id").select("doc_id", "t", "line")


@_query(f"SELECT doc_id, {_SUBJECT_SQL} AS passes FROM documents")
def o62_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.on_subject(F.col("text"), STRONG, WEAK).alias("passes"))


@_query("SELECT doc_id, array_to_string(list_transform(cues, lambda c: c.line), ' ') AS flat FROM documents WHERE cues IS NOT NULL")
def o63_flatten(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(F.col("cues").isNotNull()).select("doc_id", transcripts.flat(F.col("cues")).alias("flat"))


@_query("""
WITH v AS (SELECT doc_id, cues, CAST(len(cues) // 2 AS INTEGER) AS k FROM documents WHERE len(cues) >= 2),
q AS (SELECT doc_id, cues, CASE WHEN doc_id % 7 = 0 THEN 'nulle part ' ELSE '' END || substr(cues[k].line, CAST(length(cues[k].line) // 2 AS INTEGER) + 1) || ' ' || cues[k + 1].line AS quote FROM v),
p AS (SELECT doc_id, cues, strpos(array_to_string(list_transform(cues, lambda c: c.line), ' '), trim(quote)) - 1 AS pos FROM q),
e AS (SELECT doc_id, pos, i, cues[i].t AS t, sum(length(cues[i].line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (SELECT doc_id, pos, cues, unnest(range(1, len(cues) + 1)) AS i FROM p))
SELECT doc_id, CAST(first(t ORDER BY i) FILTER (pos >= 0 AND ends > pos) AS INTEGER) AS second FROM e GROUP BY ALL""")
def o64_locate(spark: SparkSession, d: str) -> DataFrame:
    """No stored quote stands in cues: a quote is made of each video's two middle cues, and spoilt for every seventh number."""
    v = load(spark, d, "documents").where(F.size("cues") >= 2).select("doc_id", "cues", F.floor(F.size("cues") / 2).cast("int").alias("k"))
    line = F.element_at("cues", F.col("k"))["line"]
    half = F.substring(line, F.floor(F.length(line) / 2).cast("int") + 1, F.length(line))
    quote = F.concat(F.when(F.col("doc_id") % 7 == 0, "nulle part ").otherwise(""), half, F.lit(" "), F.element_at("cues", F.col("k") + 1)["line"])
    return v.select("doc_id", transcripts.locate(F.col("cues"), quote).alias("second"))


@_query("SELECT doc_id, CAST(round(length(text) / 3.5) AS INTEGER) AS tokens FROM documents")
def o65_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.tokens_estimate(F.col("text")).alias("tokens"))


_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CHUNKS = rf"""
t AS (SELECT doc_id, url_hash, person, regexp_replace(regexp_replace(text, '^{_WS}', ''), '{_WS}$', '') AS x FROM documents),
w AS (
  SELECT doc_id, 0 AS beg, least(6000, length(x)) AS stop FROM t WHERE length(x) > 0
  UNION ALL
  SELECT doc_id, nxt, least(nxt + 6000, n) FROM (SELECT w.doc_id, greatest(e.cut - 400, w.beg + 1) AS nxt, length(t.x) AS n, e.cut FROM w JOIN t USING (doc_id) JOIN LATERAL (SELECT {{cut}} AS cut) e ON true WHERE w.stop < length(t.x)) z WHERE cut < n
)"""


def _cut(x: str, at: str, stop: str) -> str:
    """SQL: the end of a window: after the last blank line, else the last full stop, of its second half."""
    part = f"substr({x}, {at} + 3001, {stop} - {at} - 3000)"
    last = lambda m: f"(length({part}) - strpos(reverse({part}), reverse({m})) - 1)"
    nl, dot = "chr(10) || chr(10)", "'. '"
    return f"CASE WHEN {stop} >= length({x}) THEN {stop} WHEN contains({part}, {nl}) THEN {at} + 3000 + {last(nl)} + 1 WHEN contains({part}, {dot}) THEN {at} + 3000 + {last(dot)} + 1 ELSE {stop} END"


_CHUNK_SQL = f"""
WITH RECURSIVE {_CHUNKS.replace("{cut}", _cut("t.x", "w.beg", "w.stop"))},
p AS (SELECT doc_id, url_hash, person, beg, regexp_replace(regexp_replace(substr(x, beg + 1, ({_cut("t.x", "w.beg", "w.stop")}) - beg), '^{_WS}', ''), '{_WS}$', '') AS chunk FROM w JOIN t USING (doc_id)),
c AS (SELECT doc_id, url_hash, person, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY beg) - 1 AS INTEGER) AS chunk_no, chunk FROM p WHERE chunk <> '')"""


@_query(_CHUNK_SQL + " SELECT doc_id, chunk_no, sha256(chunk) AS text_sha256, CAST(length(chunk) AS INTEGER) AS n_chars FROM c")
def o66_chunks(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    c = chunks(load(spark, d, "documents"), ["doc_id"])
    return c.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("text_sha256"), F.length("chunk").alias("n_chars"))


_ASCII = r"trim(regexp_replace(lower(regexp_replace(quote_fr, '[^\x{0}-\x{7f}]+', '', 'g')), '[\s\x{1c}-\x{1f}]+', ' ', 'g'))"


@_query(f"""
WITH q AS (SELECT claim_no, source_url, {_ASCII} AS q FROM claims)
SELECT a.claim_no AS claim_no, b.claim_no AS other_no FROM q a JOIN q b ON a.source_url = b.source_url AND a.claim_no < b.claim_no AND a.q <> '' AND b.q <> '' AND (contains(a.q, b.q) OR contains(b.q, a.q))""")
def o68_same_quote(spark: SparkSession, d: str) -> DataFrame:
    """(claim_no, other_no): claims on one address whose quotes a reader takes as the same, by their ASCII letters, for which SQL has the same forms."""
    q = load(spark, d, "claims").select("claim_no", F.col("source_url").alias("url"), T.reader_form(F.regexp_replace("quote_fr", r"[^\x00-\x7f]+", "")).alias("q"))
    kept = cut(q)
    both = join_cells(kept, kept.select(F.col("claim_no").alias("other_no"), "url", F.col("q").alias("p")), ["url"])
    return both.where((F.col("claim_no") < F.col("other_no")) & positions.same_quote(F.col("q"), F.col("p"))).select("claim_no", "other_no")


@_query("""SELECT claim_no, CASE WHEN claim_type = 'video' AND timestamp_s IS NOT NULL THEN source_url || CASE WHEN contains(source_url, '?') THEN '&t=' ELSE '?t=' END || timestamp_s ELSE source_url END AS cited FROM claims""")
def o69_citation(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "claims").select("claim_no", T.cited_at(F.col("source_url"), F.col("claim_type"), F.col("timestamp_s")).alias("cited"))


@_query("SELECT doc_id, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), url) AS host FROM documents")
def o70_host(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.host(F.col("url")).alias("host"))


# -- extraction --------------------------------------------------------------------------------------


@_query(_CHUNK_SQL + " SELECT doc_id, url_hash || ':' || chunk_no AS custom_id, coalesce(full_name, person) AS person_name, sha256(chunk) AS text_sha256, CAST(length(chunk) AS INTEGER) AS n_chars FROM c LEFT JOIN people ON slug = person")
def o71_requests(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return extraction.requests(load(spark, d, "documents"), load(spark, d, "people"))


@_query("SELECT custom_id, sha256(arg_max(payload, (received_at, record_no))) AS payload_sha256 FROM claim_payloads GROUP BY ALL")
def o73_submitted(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "claim_payloads").withColumn("payload_sha256", F.sha2("payload", 256))
    return extraction.submitted(p, "payload_sha256", ["received_at", "record_no"])


@_query("""
WITH want AS (SELECT url_hash AS custom_id, sha256(text) AS text_sha256, doc_id FROM documents),
sent AS (SELECT url_hash AS custom_id, sha256(text) AS text_sha256 FROM documents WHERE fetched_at < TIMESTAMPTZ '2026-01-01 00:00:00+00')
SELECT custom_id, text_sha256, doc_id FROM want ANTI JOIN sent USING (custom_id, text_sha256)""")
def o74_unsent(spark: SparkSession, d: str) -> DataFrame:
    """What is still to be sent, where all that was fetched before 2026 was sent."""
    docs = load(spark, d, "documents").select(F.col("url_hash").alias("custom_id"), F.sha2("text", 256).alias("text_sha256"), "doc_id", "fetched_at")
    sent = docs.where(F.col("fetched_at") < F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return extraction.unsent(docs.drop("fetched_at"), sent).select("custom_id", "text_sha256", "doc_id")


@_query("SELECT DISTINCT batch_id FROM claim_payloads WHERE batch_id NOT IN (SELECT batch_id FROM claim_payloads WHERE received_at < TIMESTAMPTZ '2025-09-01 00:00:00+00')")
def o75_pending(spark: SparkSession, d: str) -> DataFrame:
    """Batches that were still waiting for their first answer on the first of September 2025."""
    p = load(spark, d, "claim_payloads").select("batch_id", "received_at")
    return extraction.pending_batches(p, p.where(F.col("received_at") < F.lit("2025-09-01 00:00:00").cast("timestamp")))


@_query("""
WITH gone AS (SELECT batch_id FROM claim_payloads GROUP BY batch_id HAVING NOT bool_and(json_valid(payload)))
SELECT custom_id, record_no, sha256(payload) AS text_sha256 FROM claim_payloads WHERE batch_id NOT IN (SELECT batch_id FROM gone)""")
def o78_requeued(spark: SparkSession, d: str) -> DataFrame:
    """Requests that count as sent where a batch with an answer that broke off has expired as a whole."""
    p = load(spark, d, "claim_payloads")
    expired = p.where(F.try_parse_json("payload").isNull()).select("batch_id")
    return extraction.requeued(p, expired).select("custom_id", "record_no", F.sha2("payload", 256).alias("text_sha256"))


_KNOWN = ", ".join(f"'{x.split()[0]}'" for x in extraction.ANSWER.split(", "))
_AXES = ", ".join(f"'{x}'" for x in extraction.AXES)
_TYPES = ", ".join(f"'{x}'" for x in extraction.CLAIM_TYPES)
_PARSED = rf"""
j AS (SELECT record_no, custom_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM claim_payloads),
a AS (SELECT record_no, custom_id, json_keys(p) AS keys, p ->> '$.axis' AS axis, p ->> '$.claim_type' AS claim_type, p ->> '$.date' AS date, p ->> '$.quote_fr' AS quote_fr,
      p ->> '$.quote_gloss_en' AS gloss, p ->> '$.position_fr' AS position_fr, trim(regexp_replace(p ->> '$.quote_fr', '{_WS}', ' ', 'g')) AS flat FROM j),
ok AS (SELECT *, coalesce(len(list_filter(keys, lambda k: k NOT IN ({_KNOWN}))) = 0, false) AND coalesce(axis IN ({_AXES}), false) AND coalesce(claim_type IN ({_TYPES}), false)
      AND coalesce(flat <> '' AND len(string_split(flat, ' ')) <= 40, false) AND coalesce(regexp_matches(gloss, '[^ ]'), false) AND coalesce(regexp_matches(position_fr, '[^ ]'), false) AS valid FROM a)"""


@_query(f"WITH {_PARSED} SELECT record_no, custom_id, axis, valid FROM ok")
def o76_validated(spark: SparkSession, d: str) -> DataFrame:
    return extraction.parsed(load(spark, d, "claim_payloads")).select("record_no", "custom_id", "axis", "valid")


@_query(rf"""
WITH {_PARSED},
v AS (SELECT url_hash, url, cues, person AS doc_person, tier AS doc_tier, tier_confirmed, archive_url FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY fetched_at DESC, doc_id DESC) AS rn FROM documents) WHERE rn = 1),
c AS (SELECT *, regexp_replace(regexp_replace(quote_fr, '^{_WS}', ''), '{_WS}$', '') AS q FROM ok JOIN v ON url_hash = split_part(custom_id, ':', 1) WHERE valid),
l AS (SELECT record_no, i, cues[i].t AS t, strpos(array_to_string(list_transform(cues, lambda c: c.line), ' '), q) - 1 AS pos, sum(length(cues[i].line) + 1) OVER (PARTITION BY record_no ORDER BY i) AS ends
      FROM (SELECT record_no, cues, q, unnest(range(1, len(cues) + 1)) AS i FROM c WHERE cues IS NOT NULL)),
located AS (SELECT record_no, CAST(first(t ORDER BY i) FILTER (pos >= 0 AND ends > pos) AS INTEGER) AS second FROM l GROUP BY ALL)
SELECT record_no, substr(sha256(url || chr(10) || q), 1, 16) AS claim_id, doc_person AS person, axis, CASE WHEN cues IS NOT NULL THEN 'video' ELSE claim_type END AS claim_type,
       TRY_CAST(regexp_replace(nullif(regexp_extract(date, '^\d{{4}}-?\d{{2}}-?\d{{2}}'), ''), '^(\d{{4}})-?(\d{{2}})-?(\d{{2}})$', '\1-\2-\3') AS DATE) AS claim_date, q AS quote_fr, gloss AS quote_gloss_en, position_fr,
       doc_tier AS tier, tier_confirmed, url AS source_url, archive_url, second AS timestamp_s, DATE '2026-01-15' AS last_verified, 'pending' AS status
FROM c LEFT JOIN located USING (record_no)""")
def o77_collected(spark: SparkSession, d: str) -> DataFrame:
    return extraction.collected(extraction.parsed(load(spark, d, "claim_payloads")), load(spark, d, "documents"), "2026-01-15")


_FATE = f"""
fate AS (SELECT record_no, custom_id, payload,
  CASE record_no % 23 WHEN 3 THEN 'server_error' END AS error, CASE record_no % 19 WHEN 4 THEN 429 WHEN 9 THEN 500 ELSE 200 END AS status, CASE record_no % 17 WHEN 5 THEN 'no' ELSE '' END AS refusal,
  CASE WHEN record_no % 13 = 6 THEN 'length' ELSE 'stop' END AS finish, CASE WHEN record_no % 11 = 7 THEN '  ' ELSE payload END AS content FROM claim_payloads),
told AS (SELECT record_no, custom_id AS answers, CASE WHEN error IS NOT NULL THEN 'error: ' || error WHEN status <> 200 THEN 'status ' || status WHEN refusal <> '' THEN 'refused: ' || refusal WHEN finish = 'length' THEN 'truncated'
  WHEN regexp_matches(coalesce(content, ''), '^({_WS})?$') THEN 'empty' WHEN NOT json_valid(content) THEN 'unparseable' END AS reason FROM fate)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The stored payloads as lines of a result file, some of them given an error, a status, a refusal or an end by their number."""
    p, no = load(spark, d, "claim_payloads"), F.col("record_no")
    choice = F.struct(
        F.struct(F.when(no % 11 == 7, "  ").otherwise(F.col("payload")).alias("content"), F.when(no % 17 == 5, "no").otherwise("").alias("refusal")).alias("message"), F.when(no % 13 == 6, "length").otherwise("stop").alias("finish_reason")
    )
    status = F.when(no % 19 == 4, 429).when(no % 19 == 9, 500).otherwise(200)
    line = F.struct("custom_id", F.when(no % 23 == 3, "server_error").alias("error"), F.struct(status.alias("status_code"), F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))
    return extraction.results(p.select("record_no", F.to_json(line).alias("line")))


@_query(f"WITH {_FATE} SELECT record_no, answers, reason FROM told")
def o79_unusable(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("record_no", "answers", "reason")


@_query(f"WITH {_FATE} SELECT reason, count(*) AS n FROM told WHERE reason IS NOT NULL GROUP BY reason")
def o82_tally(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


# -- positions ---------------------------------------------------------------------------------------


def _tidy(claims: DataFrame) -> DataFrame:
    """Claims with person and axis in one spelling."""
    low = lambda c: F.regexp_replace(F.lower(T.strip(F.col(c))), r"[^\p{L}\p{N}]+", "-")
    return claims.withColumn("person", low("person")).withColumn("axis", low("axis"))


_TIDY = rf"""
tidy AS (SELECT * REPLACE (regexp_replace(regexp_replace(lower(person), '^{_WS}|{_WS}$', '', 'g'), '[^\p{{L}}\p{{N}}]+', '-', 'g') AS person,
                           regexp_replace(regexp_replace(lower(axis), '^{_WS}|{_WS}$', '', 'g'), '[^\p{{L}}\p{{N}}]+', '-', 'g') AS axis) FROM claims)"""


@_query(f"""WITH {_TIDY} SELECT person, axis, count(DISTINCT claim_id) AS n_claims, count(DISTINCT source_url) AS n_sources, min(claim_id) AS first_id, max(claim_id) AS last_id FROM tidy GROUP BY ALL""")
def o90_cells(spark: SparkSession, d: str) -> DataFrame:
    return positions.cells(_tidy(load(spark, d, "claims")))


@_query(f"WITH {_TIDY} SELECT DISTINCT person, axis, claim_id, source_url FROM tidy")
def o92_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each placement in long form."""
    return positions.evidence(_tidy(load(spark, d, "claims")))


@_query(rf"""
WITH {_TIDY},
a AS (SELECT person, axis, count(DISTINCT source_url) < 2 AS one, bool_or(claim_date IS NULL) AS undated, bool_or(NOT {_GOOD}) AS uncaptured,
      bool_or(coalesce(tier <> '1', true)) AS others, bool_or(NOT coalesce(tier_confirmed, false)) AS unconfirmed FROM tidy GROUP BY ALL)
SELECT person, axis, CASE WHEN one OR undated OR uncaptured THEN 'thin' WHEN others OR unconfirmed THEN 'sourced' ELSE 'attested' END AS reliability,
concat_ws('; ', CASE WHEN one THEN 'single source' END, CASE WHEN undated THEN 'undated quote' END, CASE WHEN uncaptured THEN 'no usable capture' END,
          CASE WHEN others THEN 'not the person''s own words' END, CASE WHEN unconfirmed THEN 'tier unconfirmed' END) AS caveats FROM a""")
def o91_reliability(spark: SparkSession, d: str) -> DataFrame:
    r = positions.reliability(_tidy(load(spark, d, "claims")), CAPTURE)
    return r.select("person", "axis", "reliability", F.array_join("caveats", "; ").alias("caveats"))


@_query(f"""
WITH {_TIDY}, ids AS (SELECT DISTINCT person, axis, claim_id FROM tidy), there AS (SELECT DISTINCT claim_id AS id FROM claims WHERE status <> 'retracted')
SELECT person, axis, count(id) AS n_found, count(*) - count(id) AS n_missing FROM ids LEFT JOIN there ON id = claim_id GROUP BY ALL""")
def o93_trace(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the cells against the claims that were not retracted."""
    claims = load(spark, d, "claims")
    return positions.trace(positions.evidence(_tidy(claims)), claims.where("status <> 'retracted'"))


@_query()
def o94_gold(spark: SparkSession, d: str) -> DataFrame:
    """Answers scored against the reviewed claims of the same documents; documents without any are labelled empty."""
    docs = load(spark, d, "documents")
    one = store.earliest(docs.select("url", "url_hash", "doc_id"), ["url"], ["doc_id"]).select("url", "url_hash")
    claims = _tidy(load(spark, d, "claims")).where("status <> 'pending'").select(F.col("source_url").alias("url"), "axis", F.col("quote_fr").alias("quote")).distinct()
    gold = one.join(claims, "url", "left").select("url_hash", "axis", "quote")
    answers = extraction.parsed(load(spark, d, "claim_payloads")).where("valid")
    said = answers.select(F.substring_index("custom_id", ":", 1).alias("url_hash"), F.col("record_no").alias("pos"), "axis", F.col("quote_fr").alias("quote"))
    return positions.scorecard(gold, said, docs.select("url_hash", "text"))


@_query(r"""
WITH v AS (SELECT video_id, ltrim(regexp_extract(speaker, '(\d+)[^\d]*$', 1), '0') AS n, speaker, end_s - start_s AS s FROM (SELECT DISTINCT * FROM turns)),
p AS (SELECT video_id, CASE WHEN n = '' THEN '0' ELSE n END AS voice, sum(s) AS s FROM v WHERE regexp_matches(coalesce(speaker, ''), '\d') GROUP BY ALL),
t AS (SELECT video_id, sum(s) AS total, max(s) AS most, arg_max(voice, (s, voice)) AS voice FROM p GROUP BY ALL)
SELECT video_id, voice, round(most / total, 6) AS share FROM t WHERE most / total > 0.5""")
def o95_dominant(spark: SparkSession, d: str) -> DataFrame:
    v = transcripts.dominant_voices(_voices(spark, d))
    return v.select("video_id", "voice", F.round("share", 6).alias("share"))


def _voices(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of speech with a known voice number; rows stored twice count once."""
    t = load(spark, d, "turns").select("video_id", "turn_no", "start_s", "end_s", "speaker", "text").distinct()
    n = F.regexp_extract(F.coalesce("speaker", F.lit("")), r"(\d+)\D*$", 1)
    return t.withColumn("voice", F.regexp_replace(n, r"^0+(?=\d)", "")).where("voice <> ''").drop("speaker")


@_query(r"""
WITH v AS (SELECT DISTINCT video_id, turn_no, start_s, end_s, text, coalesce(nullif(ltrim(regexp_extract(speaker, '(\d+)[^\d]*$', 1), '0'), ''), '0') AS voice FROM turns WHERE regexp_matches(coalesce(speaker, ''), '\d')),
p AS (SELECT video_id, voice, sum(end_s - start_s) AS s FROM v GROUP BY ALL),
t AS (SELECT video_id, arg_max(voice, (s, voice)) AS voice FROM p GROUP BY ALL HAVING max(s) / sum(s) > 0.5)
SELECT video_id, voice, CAST(count(*) AS INTEGER) AS n_turns, string_agg(text, ' ' ORDER BY start_s, turn_no) AS text FROM v SEMI JOIN t USING (video_id, voice) GROUP BY ALL""")
def o96_voice_text(spark: SparkSession, d: str) -> DataFrame:
    v = _voices(spark, d)
    return transcripts.voice_texts(v, transcripts.dominant_voices(v))


_VOICE = "v AS (SELECT DISTINCT video_id, turn_no, start_s, end_s, text, coalesce(nullif(ltrim(regexp_extract(speaker, '(\\d+)[^\\d]*$', 1), '0'), ''), '0') AS voice FROM turns WHERE regexp_matches(coalesce(speaker, ''), '\\d'))"


@_query(f"""
WITH {_STAND_INS_SQL}, n AS (SELECT slug, lower(unnest(match_names)) AS name FROM people),
m AS (SELECT lead_no, list(DISTINCT slug) AS named FROM leads JOIN n ON CASE WHEN contains(lower(title), name) THEN regexp_matches(lower(title), '(^|[^\\p{{L}}\\p{{N}}_])' || name || '($|[^\\p{{L}}\\p{{N}}_])') ELSE false END GROUP BY ALL),
once AS (SELECT min(lead_no) AS lead_no, url, person FROM (SELECT lead_no, url, CASE WHEN lead_no % 5 = 0 THEN 'drones' ELSE coalesce(list_min(named), '') END AS person FROM leads LEFT JOIN m USING (lead_no)) GROUP BY url, person),
{_VOICE}, w AS (SELECT video_id, voice, sum(end_s - start_s) AS s FROM v GROUP BY ALL), t AS (SELECT video_id, arg_max(voice, (s, voice)) AS voice FROM w GROUP BY ALL HAVING max(s) / sum(s) > 0.3),
own AS (SELECT video_id, {_SUBJECT_SQL} AS said FROM (SELECT video_id, string_agg(text, ' ' ORDER BY start_s, turn_no) AS text FROM v SEMI JOIN t USING (video_id, voice) GROUP BY ALL)),
shown AS (SELECT video_id, {_SUBJECT_SQL} AS shown FROM (SELECT video_id, string_agg(line, ' ' ORDER BY t, seq, line) AS text FROM cues GROUP BY ALL))
SELECT o.lead_no AS lead_no, CASE WHEN named IS NULL OR len(named) <> 1 OR named[1] <> person THEN 'title names another or several' WHEN NOT shown THEN 'captions off subject'
  WHEN said IS NULL THEN 'no dominant voice' WHEN NOT said THEN 'own words off subject' ELSE 'promoted' END AS reason
FROM once o LEFT JOIN m ON m.lead_no = o.lead_no LEFT JOIN shown ON shown.video_id = o.lead_no LEFT JOIN own ON own.video_id = o.lead_no""")
def o97_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Leads by the first reason that keeps them from promotion. Stand-ins: STAND_INS for people, the video of a lead's number for its own."""
    who = routing.named(F.col("title"), routing.name_patterns(_stand_ins(spark)))
    person = F.when(F.col("lead_no") % 5 == 0, "drones").otherwise(F.coalesce(F.array_min(who), F.lit("")))
    leads = load(spark, d, "leads").select("lead_no", "url", "title", person.alias("person"), F.col("lead_no").alias("video_id"))
    voices = _voices(spark, d)
    own = transcripts.voice_texts(voices, transcripts.dominant_voices(voices, 0.3))
    said = F.array_sort(F.collect_list(F.struct("t", "seq", "line")))
    shown = load(spark, d, "cues").groupBy("video_id").agg(said.alias("x")).select("video_id", F.array_join(F.transform("x", lambda c: c["line"]), " ").alias("text"))
    return routing.promotion(leads, who, shown, own, lambda c: T.on_subject(c, STRONG, WEAK))


_GRID = f"""
axes AS (SELECT unnest([{_AXES}]) AS axis),
last AS (SELECT person, axis, arg_max(claim_id, (coalesce(CAST(claim_date AS VARCHAR), 'None'), claim_no)) AS claim_id FROM tidy GROUP BY ALL),
grid AS (SELECT p.slug AS person, axes.axis AS axis, claim_id FROM (SELECT DISTINCT slug FROM people) p CROSS JOIN axes LEFT JOIN last ON last.person = p.slug AND last.axis = axes.axis)"""


@_query(f"WITH {_TIDY}, {_GRID} SELECT person, axis, claim_id FROM grid")
def o98_grid(spark: SparkSession, d: str) -> DataFrame:
    return positions.grid(_tidy(load(spark, d, "claims")), load(spark, d, "people"), extraction.AXES).select("person", "axis", "claim_id")


_WATCHED = "SELECT slug AS person, coalesce(len(list_filter(sources, lambda s: coalesce(s.enabled, true))) > 0, false) AS monitored FROM people"


@_query(_WATCHED)
def o99_monitored(spark: SparkSession, d: str) -> DataFrame:
    return positions.monitored(load(spark, d, "people"))


@_query("SELECT claim_no, claim_id, claim_date FROM claims ORDER BY coalesce(CAST(claim_date AS VARCHAR), 'None') DESC, claim_id DESC, claim_no DESC LIMIT 50")
def o100_feed(spark: SparkSession, d: str) -> DataFrame:
    return positions.feed(load(spark, d, "claims").select("claim_no", "claim_id", "claim_date"), 50)


@_query(f"WITH {_TIDY} SELECT person, claim_no, claim_id, claim_date FROM tidy JOIN people ON slug = person")
def o101_person_pages(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "people").select(F.col("slug").alias("person"))
    return _tidy(load(spark, d, "claims")).join(people, "person").select("person", "claim_no", "claim_id", "claim_date")


@_query(f"WITH {_TIDY} SELECT count(*) AS n_claims, count(DISTINCT person) AS n_persons, count(DISTINCT axis) AS n_axes FROM tidy")
def o102_header(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(load(spark, d, "claims")).agg(F.count("*").alias("n_claims"), F.countDistinct("person").alias("n_persons"), F.countDistinct("axis").alias("n_axes"))


@_query("""
SELECT source_id, arg_min(doc_id, (length(text), doc_id)) AS shortest, arg_max(doc_id, (length(text), doc_id)) AS longest FROM documents GROUP BY ALL""")
def o103_pick(spark: SparkSession, d: str) -> DataFrame:
    """The shortest and the longest document of each source; aggregates, so a hot source is combined before the shuffle."""
    rows = load(spark, d, "documents").select("source_id", "doc_id", F.length("text").alias("n"))
    return rows.groupBy("source_id").agg(F.min_by("doc_id", F.struct("n", "doc_id")).alias("shortest"), F.max_by("doc_id", F.struct("n", "doc_id")).alias("longest"))


@_query(r"""
WITH v AS (SELECT DISTINCT video_id, turn_no, start_s, end_s, text, coalesce(nullif(ltrim(regexp_extract(speaker, '(\d+)[^\d]*$', 1), '0'), ''), '0') AS voice FROM turns WHERE regexp_matches(coalesce(speaker, ''), '\d')),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, voice ORDER BY start_s, turn_no) AS rn, count(*) OVER (PARTITION BY video_id, voice) AS n FROM v)
SELECT video_id, voice, CAST(share AS DOUBLE) AS share, turn_no FROM r, (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS share) WHERE rn = floor(n * share) + 1""")
def o104_sample_positions(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.sample_turns(_voices(spark, d))


@_query("""
WITH once AS (SELECT source_id, seq, max(fetched) AS fetched FROM source_runs GROUP BY ALL),
     last AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM once),
     dead AS (SELECT source_id AS id FROM last WHERE rn <= 3 GROUP BY ALL HAVING count(*) >= 3 AND max(fetched) = 0),
     runs AS (SELECT DISTINCT * FROM source_runs)
SELECT source_id, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(kept) AS BIGINT) AS kept, sum(fetched) = 0 AS empty, source_id IN (SELECT id FROM dead) AS silent FROM runs GROUP BY source_id""")
def o105_run_report(spark: SparkSession, d: str) -> DataFrame:
    runs = load(spark, d, "source_runs")
    return store.run_report(runs.distinct(), store.silent_sources(runs))


# -- pages -------------------------------------------------------------------------------------------

_PAGES = "pages AS (SELECT DISTINCT slug, l.locale AS locale, '/' || l.locale || '/' || l.segment || '/' || slug || '/' AS path FROM people, (VALUES ('fr', 'personne'), ('en', 'person')) l(locale, segment))"


@_query(f"WITH {_PAGES} SELECT slug, locale, path FROM pages")
def o110_alternates(spark: SparkSession, d: str) -> DataFrame:
    return site.person_pages(load(spark, d, "people"))


@_query(f"""WITH {_PAGES}, u AS (SELECT slug, locale, 'https://site.example' || path AS loc FROM pages)
SELECT a.loc AS loc, b.locale AS hreflang, b.loc AS href FROM u a JOIN u b USING (slug) UNION ALL SELECT a.loc, 'x-default', b.loc FROM u a JOIN u b USING (slug) WHERE b.locale = 'fr'""")
def o111_sitemap(spark: SparkSession, d: str) -> DataFrame:
    return site.sitemap(site.person_pages(load(spark, d, "people")), "https://site.example")


_LABELS = ", ".join("('{}', '{}')".format(k, v[1].replace("'", "''")) for k, v in site.AXIS_LABELS.items())


@_query(f"WITH {_TIDY} SELECT claim_no, axis, coalesce(label, axis) AS label FROM tidy LEFT JOIN (VALUES {_LABELS}) l(key, label) ON key = axis")
def o112_labels(spark: SparkSession, d: str) -> DataFrame:
    return site.labelled(_tidy(load(spark, d, "claims")).select("claim_no", "axis"), "axis", site.AXIS_LABELS, "en").select("claim_no", "axis", "label")


@_query(f"""WITH {_TIDY}, {_PAGES}, per AS (SELECT person, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(claim_id), 1, 8) AS BIGINT)) AS BIGINT) AS s FROM (SELECT DISTINCT person, claim_id FROM tidy) GROUP BY ALL)
SELECT path, locale, coalesce(n, 0) AS n_claims, coalesce(s, 0) AS content_key FROM pages LEFT JOIN per ON person = slug""")
def o113_manifest(spark: SparkSession, d: str) -> DataFrame:
    return site.manifest(site.person_pages(load(spark, d, "people")), _tidy(load(spark, d, "claims")))


@_query(f"""WITH {_TIDY}, {_GRID}, w AS ({_WATCHED})
SELECT grid.person AS person, axis, CASE WHEN NOT coalesce(monitored, false) THEN 'unmonitored' WHEN claim_id IS NOT NULL THEN 'claim' ELSE 'none' END AS state FROM grid LEFT JOIN w ON w.person = grid.person""")
def o114_cell_states(spark: SparkSession, d: str) -> DataFrame:
    people = load(spark, d, "people")
    return positions.cell_states(positions.grid(_tidy(load(spark, d, "claims")), people, extraction.AXES), positions.monitored(people))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
