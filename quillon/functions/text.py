"""Text, identity and date expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() takes it; Java's \s alone is ASCII.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def word_count(c: Column) -> Column:
    s = collapse(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def blank_to(c: Column, default: str) -> Column:
    """The default where the value is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _normal(form: str, fold: bool = False):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            if not t.isascii() and not unicodedata.is_normalized(form, t):
                t = unicodedata.normalize(form, t)
            return t.casefold() if fold else t

        return s.map(one, na_action="ignore")

    return run


def nfc(c: Column) -> Column:
    return _normal("NFC")(c)


def layout_free(c: Column) -> Column:
    """Canonical composition and single spaces: layout does not count, words, case and marks do."""
    return collapse(nfc(c))


def reader_form(c: Column) -> Column:
    """What a reader takes as the same: compatibility form, case folded, one apostrophe, single spaces."""
    return collapse(F.translate(_normal("NFKC", fold=True)(c), "’ʼ", "''"))


def flatten_pages(c: Column) -> Column:
    """Text of printed pages as paragraphs: lines joined within a paragraph, blank lines between."""
    paragraphs = F.split(_normal("NFKC")(c), rf"\n{SPACE}*\n", -1)
    flat = F.filter(F.transform(paragraphs, collapse), lambda p: p != "")
    return F.array_join(flat, "\n\n")


def tokens_estimate(c: Column) -> Column:
    return F.round(F.length(c) / F.lit(3.5)).cast("int")


def document_key(url: Column, fingerprint: Column) -> Column:
    return F.substring(F.sha2(F.when(fingerprint.isNull(), url).otherwise(F.concat_ws("\n", url, fingerprint)), 256), 1, 16)


def claim_key(source_url: Column, quote: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", source_url, quote), 256), 1, 16)


def source_key(slug: Column, kind: Column, address: Column) -> Column:
    return F.concat_ws(":", slug, kind, F.substring(F.sha1(F.coalesce(address, F.lit(""))), 1, 8))


def leading_date(c: Column) -> Column:
    """A date at the very start of the text (dashes optional); null where there is none or it isn't valid."""
    parts = [F.regexp_extract(c, r"^(\d{4})-?(\d{2})-?(\d{2})", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def cited_at(url: Column, kind: Column, second: Column) -> Column:
    """The address of a quotation; of a video, at its second."""
    glue = F.when(F.instr(url, "?") > 0, "&t=").otherwise("?t=")
    return F.when((kind == "video") & second.isNotNull(), F.concat(url, glue, second.cast("string"))).otherwise(url)


def host(url: Column) -> Column:
    """Host of an address, with port and user as written; the address itself where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), url)


def capture_format(content: Column) -> Column:
    """pdf or html, by the first bytes."""
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").otherwise("html")


def quoted(literal: str) -> str:
    """A Java pattern of the literal."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E" if re.search(r"\W", literal) else literal


def any_of(terms: list[str], whole_words: bool = False) -> str:
    """A Java pattern of any of the literal terms, without regard to case; `whole_words` bounds both ends."""
    quoted = "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms)
    return rf"(?iu)\b(?:{quoted})\b" if whole_words else rf"(?iu)\b({quoted})"


# Subject terms, one of which is enough, and weaker ones, of which two different ones are needed.
STRONG_TERMS = (
    r"(?iu)intelligence\s+artificielle|\bIA\b|algorithm|machine\s+learning|apprentissage\s+automatique|\bLLM\b|chatgpt|openai|anthropic|mistral"
    r"|data\s*-?\s*cent|souverainet[ée]\s+num[ée]rique|(?:puissance|capacit[ée]s?)\s+de\s+calcul|deepfake|hypertrucage|reconnaissance\s+faciale|AI\s+Act"
)
WEAK_TERMS = r"(?iu)(\bnum[ée]rique|\bdonn[ée]es|automatisation|\brobot|\bcloud\b|technologi)"


def on_subject(c: Column, strong: str = STRONG_TERMS, weak: str = WEAK_TERMS) -> Column:
    seen = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(weak), F.lit(1)), F.lower))
    return c.rlike(strong) | (F.size(seen) >= 2)


# Beginnings of judgement words, French and English.
JUDGEMENTS = [
    "ambitieu", "audacieu", "timide", "flou", "vague", "irréaliste", "réaliste", "crédible", "incohérent", "insuffisant", "excessi", "modeste",
    "prometteu", "décevant", "révolutionnaire", "visionnaire", "pertinent", "dangereu", "remarquable", "impressionnant", "intéressant", "courageu", "raisonnable",
    "ambitious", "bold", "timid", "vague", "unrealistic", "realistic", "credible", "incoherent", "insufficient", "excessive", "modest",
    "promising", "disappointing", "revolutionary", "visionary", "relevant", "dangerous", "remarkable", "impressive", "interesting", "courageous", "reasonable", "sensible",
]
CAPTURE = r"^https://[^/]+/web/\d{14}/"


def is_capture(url: Column, pattern: str = CAPTURE) -> Column:
    """Whether an address is a dated capture; null and empty are none."""
    return F.coalesce(url, F.lit("")).rlike(pattern)
