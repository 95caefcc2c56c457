"""Queries of the training-text problems: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import encodings, ledger, lookalikes, mixing, near_duplicates, packing, page_body, repeated_lines, residue, tokens, transcripts
from quillon.session import cut, load, ship
from quillon.skew import without

#: TESTDATA.md fixes this shape for the versions of problem 7.
P7 = near_duplicates.Shape(k=3, threshold=0.5, min_words=100)
#: A bucket should hold some 100 MB of the ledger; the stored tables are small.
P4_BUCKETS = 8
KEY = ["person", "axis", "quote_fr"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return load(spark, d, "documents")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(_docs(spark, d), 5)


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "source_id", "text")
    lines = cut(repeated_lines.repeated_lines(docs, 5))
    return repeated_lines.remove_lines(docs, lines).select("doc_id", "n_removed", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residues(_docs(spark, d))


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return without(docs.select("doc_id", "title", "text"), cut(residue.residues(docs)), "doc_id")


def _p3_texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    docs, claims = _docs(spark, d), load(spark, d, "claims")
    counts = lookalikes.pair_counts(docs.select("text").unionByName(claims.select(F.col("quote_fr").alias("text"))))
    return docs, claims, counts


def _p3_rows(spark: SparkSession, d: str, only_changed: bool) -> tuple[DataFrame, DataFrame]:
    docs, claims, counts = _p3_texts(spark, d)
    a = lookalikes.consistent(docs, "doc_id", "text", counts, only_changed).withColumn("origin", F.lit("documents"))
    b = lookalikes.consistent(claims, "claim_no", "quote_fr", counts, only_changed).withColumn("origin", F.lit("claims"))
    return a, b


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    a, b = _p3_rows(spark, d, only_changed=True)
    wrong = cut(encodings.garbled(docs, encodings.train(docs)).withColumnRenamed("doc_id", "id"))
    both = without(a, wrong, "id").unionByName(b)
    return both.select("origin", F.col("id").alias("row_id")).distinct()


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    a, b = _p3_rows(spark, d, only_changed=False)
    return a.unionByName(b).select("origin", F.col("id").alias("row_id"), "changed", "text")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """The payloads that are valid JSON objects, as rows of (record_no, person, axis, quote_fr)."""
    raw = load(spark, d, "claim_payloads").select("record_no", "payload")
    # the variant type is parsed strictly, so text that is cut off is told from null fields
    v = raw.withColumn("v", F.try_parse_json("payload")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return v.select("record_no", *[F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in KEY])


def _p4_batches(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, list[DataFrame]]]:
    """origin: (keys of all rows, batches). The stored tables stand for three deliveries; each number is in one of them."""
    ship(spark)
    out = {}
    for origin, rows, no in (("claims", load(spark, d, "claims"), "claim_no"), ("claim_payloads", _payloads(spark, d), "record_no")):
        keys = cut(ledger.keyed(rows, no, KEY))
        out[origin] = (keys, [keys.where(F.pmod(F.xxhash64("no"), F.lit(3)) == k) for k in range(3)])
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for origin, (keys, batches) in _p4_batches(spark, d).items():
        part = ledger.copies(keys, ledger.build(spark, batches, P4_BUCKETS)).select(F.lit(origin).alias("origin"), "first_no", "copy_no")
        out = part if out is None else out.unionByName(part)
    return out


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for origin, (_, batches) in _p4_batches(spark, d).items():
        part = ledger.build(spark, batches, P4_BUCKETS).select(F.lit(origin).alias("origin"), "first_no", "copies")
        out = part if out is None else out.unionByName(part)
    return out


def _p5_lines(docs: DataFrame) -> DataFrame:
    whole = without(docs, cut(residue.residues(docs)), "doc_id")
    return page_body.around(whole, page_body.weights(docs))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_lines(_docs(spark, d).select("doc_id", "kind", "text", "title")).distinct()


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "kind", "text", "title")
    # p5_found leaves out the cases of p2, the pages that come out here are all freed of what is around the article
    return page_body.bodies(docs, page_body.weights(docs))


def _p6_pieces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    cues = transcripts.cue_pieces(load(spark, d, "cues"), load(spark, d, "voices"))
    return cues, transcripts.turn_pieces(load(spark, d, "turns"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = _p6_pieces(spark, d)
    return transcripts.turn_starts(cut(a)).unionByName(transcripts.turn_starts(cut(b)))


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    a, b = _p6_pieces(spark, d)
    return transcripts.clean_turns(cut(a)).unionByName(transcripts.clean_turns(cut(b)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.all_pairs(near_duplicates.versions(_docs(spark, d), P7))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(near_duplicates.versions(_docs(spark, d), P7))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(tokens.token_counts(_docs(spark, d)))
    return packing.packs(sized, load(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(p8_packs(spark, d))


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(tokens.token_counts(_docs(spark, d), ["source"]))
    rate = mixing.rates(sized, load(spark, d, "mix_targets"))
    return mixing.mixed(sized, rate), rate


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_p9(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return encodings.garbled(docs, encodings.train(docs))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return encodings.restored(docs, encodings.train(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = [
        p1_found, p1_cleaned, p2_found, p2_kept, p3_found, p3_consistent, p4_found, p4_ledger, p5_found, p5_bodies,
        p6_found, p6_turns, p7_found, p7_groups, p8_packs, p8_fill, p9_mix, p9_shares, p10_found, p10_restored,
    ]
    return {f.__name__: f for f in all_}


# Lines in the form in which they are compared; white space is what Python's split() takes as such.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINES = f"""
lines AS (
  SELECT doc_id, source_id, i AS line_no, lower(trim(regexp_replace(parts[i], '{_SPACE}', ' ', 'g'))) AS line
  FROM (SELECT doc_id, source_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, source_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND source_id IS NOT NULL))
),
often AS (SELECT source_id, line FROM lines WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)"""
_KEYS = """
keyed AS (
  SELECT origin, no,
         coalesce('=' || regexp_replace(lower(person), '[^\\p{L}\\p{N}]+', '', 'g'), '0') || '|' ||
         coalesce('=' || regexp_replace(lower(axis), '[^\\p{L}\\p{N}]+', '', 'g'), '0') || '|' ||
         coalesce('=' || regexp_replace(lower(quote_fr), '[^\\p{L}\\p{N}]+', '', 'g'), '0') AS key
  FROM (SELECT 'claims' AS origin, claim_no AS no, person, axis, quote_fr FROM claims
        UNION ALL
        SELECT 'claim_payloads', record_no, payload ->> '$.person', payload ->> '$.axis', payload ->> '$.quote_fr'
        FROM claim_payloads WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END)
),
sets AS (SELECT origin, key, min(no) AS first_no, count(DISTINCT no) AS copies FROM keyed GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can state; the others are tested against brute force."""
    return {
        "p1_found": f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines SEMI JOIN often USING (source_id, line)",
        "p1_cleaned": f"""WITH {_LINES},
bad AS (SELECT DISTINCT doc_id, line_no FROM lines SEMI JOIN often USING (source_id, line)),
parts AS (SELECT doc_id, i AS line_no, x[i] AS raw FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM parts ANTI JOIN bad USING (doc_id, line_no) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM bad GROUP BY ALL)
SELECT d.doc_id AS doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
        "p4_found": f"WITH {_KEYS} SELECT DISTINCT k.origin, s.first_no, k.no AS copy_no FROM keyed k JOIN sets s USING (origin, key) WHERE k.no <> s.first_no",
        "p4_ledger": f"WITH {_KEYS} SELECT origin, first_no, CAST(copies AS BIGINT) AS copies FROM sets",
    }
