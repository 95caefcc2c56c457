"""Chunks sent out, answers taken in: the queue is set algebra over artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.chunks import chunks
from quillon.operators.store import latest
from quillon.operators.transcripts import locate

# The closed vocabularies.
AXES = ["regulation", "souverainete", "environnement", "emploi", "formation", "services-publics", "surveillance-libertes", "securite", "defense", "peur", "financement"]
CLAIM_TYPES = ["programme", "discours", "vote", "interview", "video", "post"]
MAX_QUOTE_WORDS = 40
ANSWER = "axis STRING, claim_type STRING, date STRING, quote_fr STRING, quote_gloss_en STRING, position_fr STRING, person STRING, tier STRING"


def requests(docs: DataFrame, people: DataFrame) -> DataFrame:
    """One request per chunk: custom_id, the person's name (the slug where it is unknown), content hash."""
    c = chunks(docs, ["url_hash", "doc_id", "person"])
    names = people.select(F.col("slug").alias("person"), "full_name")
    out = c.join(F.broadcast(names) if _small(names) else names, "person", "left")
    return out.select("doc_id", F.concat_ws(":", "url_hash", F.col("chunk_no").cast("string")).alias("custom_id"), F.coalesce("full_name", "person").alias("person_name"), F.sha2("chunk", 256).alias("text_sha256"), F.length("chunk").alias("n_chars"))


def _small(rows: DataFrame, limit: int = 100_000) -> bool:
    return rows.limit(limit + 1).count() <= limit


def submitted(artifacts: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """The last content hash sent for each custom_id."""
    return latest(artifacts.select("custom_id", hash_col, *order), ["custom_id"], order).select("custom_id", hash_col)


def unsent(wanted: DataFrame, sent: DataFrame) -> DataFrame:
    """Requests that were not sent with this very content."""
    return wanted.join(sent.select("custom_id", "text_sha256").distinct(), ["custom_id", "text_sha256"], "left_anti")


def requeued(sent: DataFrame, expired: DataFrame) -> DataFrame:
    """What counts as sent: requests of batches that did not expire; the others go back to the queue."""
    return sent.join(expired.select("batch_id").distinct(), "batch_id", "left_anti")


def pending_batches(requested: DataFrame, answered: DataFrame) -> DataFrame:
    return requested.select("batch_id").distinct().join(answered.select("batch_id").distinct(), "batch_id", "left_anti")


RESULT = "custom_id STRING, error STRING, response STRUCT<status_code INT, body STRUCT<choices ARRAY<STRUCT<message STRUCT<content STRING, refusal STRING>, finish_reason STRING>>>>"


def results(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines of a result file (all other columns kept) with custom_id, content, reason: why an answer can't be used, null where it can.

    A line's own error or status comes first, then a refusal, an answer that was cut off, an empty one, one that is no JSON.
    Blank lines are none; a line that is no JSON itself has no custom_id.
    """
    r = lines.where(T.strip(F.col(line)) != "").withColumn("_r", F.from_json(line, RESULT))
    first = F.get(F.col("_r.response.body.choices"), F.lit(0))
    message, status = first["message"], F.col("_r.response.status_code")
    content = message["content"]
    reason = (
        F.when(F.col("_r.error").isNotNull(), F.concat(F.lit("error: "), F.col("_r.error")))
        .when(F.coalesce(status, F.lit(0)) != 200, F.concat(F.lit("status "), F.coalesce(status.cast("string"), F.lit("unknown"))))
        .when(F.coalesce(message["refusal"], F.lit("")) != "", F.concat(F.lit("refused: "), message["refusal"]))
        .when(first["finish_reason"] == "length", "truncated")
        .when(T.strip(F.coalesce(content, F.lit(""))) == "", "empty")
        .when(F.try_parse_json(content).isNull(), "unparseable")
    )
    return r.select("*", F.col("_r.custom_id").alias("answers"), content.alias("content"), reason.alias("reason")).drop("_r", line)


def unusable_reason(payload: Column) -> Column:
    """Why a stored answer can't be used, where nothing but its text is known: empty, truncated (it breaks off), unparseable; null where it can."""
    body = T.strip(payload)
    ok = F.try_parse_json(payload).isNotNull()
    return F.when(payload.isNull() | (body == ""), "empty").when(ok, None).when(~body.endswith("}"), "truncated").otherwise("unparseable")


def parsed(payloads: DataFrame) -> DataFrame:
    """Answers with their fields and `valid`: exactly the known keys, closed vocabularies, no blank text, a short quote."""
    p = payloads.withColumn("_a", F.from_json("payload", ANSWER)).withColumn("_keys", F.json_object_keys("payload"))
    a = p.select("record_no", "custom_id", "batch_id", "_keys", *[F.col(f"_a.{c}").alias(c) for c in (x.split()[0] for x in ANSWER.split(", "))])
    known = [x.split()[0] for x in ANSWER.split(", ")]
    filled = [F.coalesce(T.strip(F.col(c)) != "", F.lit(False)) for c in ("quote_fr", "quote_gloss_en", "position_fr")]
    valid = (
        F.coalesce(F.size(F.array_except("_keys", F.array(*map(F.lit, known)))) == 0, F.lit(False))
        & F.coalesce(F.col("axis").isin(AXES), F.lit(False))
        & F.coalesce(F.col("claim_type").isin(CLAIM_TYPES), F.lit(False))
        & F.coalesce(T.word_count(F.col("quote_fr")) <= MAX_QUOTE_WORDS, F.lit(False))
    )
    for f in filled:
        valid = valid & f
    return a.withColumn("valid", valid).drop("_keys")


def collected(answers: DataFrame, docs: DataFrame, verified: str | None = None) -> DataFrame:
    """Valid answers as claims of the document of their custom_id; others and unknown ids are dropped, row by row.

    Person, tier and addresses are the document's. A document with cues makes the claim a video's, at the second in which the quote
    begins (null where it isn't found in the cues). `verified` is the day of collection; null where none is given.
    """
    ok = answers.where("valid").withColumn("url_hash", F.substring_index("custom_id", ":", 1)).drop("person", "tier")
    d = latest(docs.select("url_hash", "url", "person", "tier", "tier_confirmed", "archive_url", "cues", "fetched_at", "doc_id"), ["url_hash"], ["fetched_at", "doc_id"])
    q = T.strip(F.col("quote_fr"))
    has_cues = F.col("cues").isNotNull()
    return ok.join(d, "url_hash").select(
        "record_no", T.claim_key(F.col("url"), q).alias("claim_id"), "person", "axis", F.when(has_cues, "video").otherwise(F.col("claim_type")).alias("claim_type"),
        T.leading_date(F.col("date")).alias("claim_date"), q.alias("quote_fr"), "quote_gloss_en", "position_fr", "tier", "tier_confirmed", F.col("url").alias("source_url"), "archive_url",
        F.when(has_cues, locate(F.col("cues"), q)).alias("timestamp_s"), F.lit(verified).cast("date").alias("last_verified"), F.lit("pending").alias("status"),
    )
