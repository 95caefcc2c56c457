"""Whose document is it: routing by tier, attribution by name, provenance by capture."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.store import earliest
from quillon.session import cut
from quillon.skew import bundles

PRESS = "press: reporting, not the person's own words"


def kept_documents(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("tier") != "3")


def to_leads(docs: DataFrame) -> DataFrame:
    """Press documents as leads: their body is dropped."""
    return docs.where(F.col("tier") == "3").select("person", "source_id", T.blank_to(F.col("title"), "(untitled)").alias("title"), "url", F.col("doc_date").alias("lead_date"), F.lit(PRESS).alias("reason"))


#: Names that go into one pattern.
NAMES_AT_ONCE = 2000


def _trie(names: list[str]) -> str:
    """A pattern of any of the names, common beginnings written once; the longest name is tried first."""
    if len(names) == 1:
        return T.quoted(names[0])
    after: dict[str, list[str]] = {}
    for n in names:
        if n:
            after.setdefault(n[0], []).append(n[1:])
    branches = [T.quoted(c) + _trie(rest) for c, rest in sorted(after.items())]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)}){'?' if '' in names else ''}"


def name_patterns(people: DataFrame) -> list[tuple[str, str]]:
    """(pattern, JSON of name: slugs) for each NAMES_AT_ONCE names of the people, in lower case; as many patterns as it takes."""
    slugs: dict[str, set[str]] = {}
    for r in people.where(F.size("match_names") > 0).select("slug", "match_names").toLocalIterator():
        for n in r["match_names"]:
            if n:
                slugs.setdefault(n.lower(), set()).add(r["slug"])
    names, out = sorted(slugs), []
    for at in range(0, len(names), NAMES_AT_ONCE):
        some = names[at : at + NAMES_AT_ONCE]
        # where a name is found, shorter names that end at a word's end within it are found as well
        whole = _with_shorter(some, slugs)
        out.append((rf"(?u)(?=\b({_trie(some)})\b)", json.dumps(whole, ensure_ascii=False)))
    return out


def _with_shorter(names: list[str], slugs: dict[str, set[str]]) -> dict[str, list[str]]:
    """For each name the people of it and of the names it begins with (sorted names: those stand before it on a stack)."""
    out, stack = {}, []
    for n in names:
        while stack and not n.startswith(stack[-1]):
            stack.pop()
        stack.append(n)
        ends = [m for m in stack if m == n or not (n[len(m)].isalnum() or n[len(m)] == "_")]
        out[n] = sorted({s for m in ends for s in slugs[m]})
    return out


def named(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The people whose names stand in the text as words (distinct). One scan of the text for all names of a pattern: at each
    place the longest name is taken, the shorter ones that it begins with are known beforehand."""
    low = F.lower(text)

    def people(pattern: str, names: str) -> Column:
        of = F.from_json(F.lit(names), "map<string,array<string>>")
        return F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1))), lambda n: F.element_at(of, n))

    found = [people(p, names) for p, names in patterns]
    return F.array_distinct(F.flatten(F.concat(*found))) if found else F.array().cast("array<string>")


def attributed(rows: DataFrame, text: Column, people: DataFrame) -> DataFrame:
    """One row per row and person named in `text` (column `named_person`); rows that name nobody are dropped."""
    return rows.withColumn("named_person", F.explode(named(text, name_patterns(people))))


def attach_archives(claims: DataFrame, docs: DataFrame, capture: str = T.CAPTURE) -> DataFrame:
    """(claim_no, archive_url, attached, requested): for claims without a usable capture, the first one that holds the quote.

    Candidates are the document's versions, the oldest first, then captures of other claims of the same
    address. Where no version was ever captured, a new capture is requested. The quotes of an address go to its
    texts in bundles; a sibling's capture holds the page as its newest version, so that is searched once,
    and of the siblings only the first is kept.
    """
    good = T.is_capture(F.col("archive_url"), capture)
    need = claims.where(~good).select("claim_no", F.col("source_url").alias("url"), T.layout_free(F.col("quote_fr")).alias("quote"))
    cited = cut(bundles(need.where("quote <> ''"), ["url"], ["claim_no", "quote"]))
    dated = F.struct("fetched_at", F.col("doc_id").alias("no"))
    newest = docs.join(cited.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max(F.struct("fetched_at", "doc_id")).alias("last"))
    rows = docs.join(newest, "url").select("url", "text", dated.alias("rank"), F.when(good, F.col("archive_url")).alias("archive_url"), (F.struct("fetched_at", "doc_id") == F.col("last")).alias("newest"))
    # versions that were never captured count only as the newest
    met = rows.where(F.col("archive_url").isNotNull() | F.col("newest")).join(cited, "url").select(T.layout_free(F.col("text")).alias("body"), "rank", "archive_url", "newest", "items")
    hits = met.select("*", F.explode("items").alias("x")).where(F.contains("body", "x.quote"))
    per = hits.groupBy(F.col("x.claim_no").alias("claim_no")).agg(F.min(F.when(F.col("archive_url").isNotNull(), F.struct("rank", "archive_url"))).alias("own"), F.max("newest").alias("in_newest"))
    sibling = claims.where(good).groupBy(F.col("source_url").alias("url")).agg(F.min_by("archive_url", "claim_no").alias("sibling"))
    ever = docs.where(good).select("url").distinct().withColumn("captured", F.lit(True))
    out = need.join(per, "claim_no", "left").join(sibling, "url", "left").join(ever, "url", "left")
    first = F.coalesce(F.col("own.archive_url"), F.when(F.col("in_newest"), F.col("sibling")))
    return out.select("claim_no", first.alias("archive_url"), first.isNotNull().alias("attached"), (first.isNull() & F.col("captured").isNull()).alias("requested"))


def promotion(leads: DataFrame, named_: Column, captions: DataFrame, own: DataFrame, about: Callable[[Column], Column], done: DataFrame | None = None) -> DataFrame:
    """(lead_no, reason): the first reason that keeps a lead from promotion, or `promoted`; each (url, person) once, and none of `done` (url, person).

    captions: (video_id, text) where there are captions; own: (video_id, text), the dominant voice's own words, where there is one.
    Leads have lead_no, url, person, video_id; `about` says whether a text is on the subject.
    """
    once = earliest(leads, ["url", "person"], ["lead_no"])
    if done is not None:
        once = once.join(done.select("url", "person").distinct(), ["url", "person"], "left_anti")
    shown = captions.groupBy("video_id").agg(F.max(about(F.col("text"))).alias("_shown"))
    said = own.groupBy("video_id").agg(F.max(about(F.col("text"))).alias("_said"))
    j = once.withColumn("_named", F.coalesce(named_, F.array().cast("array<string>"))).join(shown, "video_id", "left").join(said, "video_id", "left")
    single = (F.size("_named") == 1) & F.array_contains("_named", F.col("person"))
    reason = (
        F.when(~F.coalesce(single, F.lit(False)), "title names another or several").when(~F.col("_shown"), "captions off subject")
        .when(F.col("_said").isNull(), "no dominant voice").when(~F.col("_said"), "own words off subject").otherwise("promoted")
    )
    return j.select("lead_no", reason.alias("reason"))
