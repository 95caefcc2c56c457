"""Template residue and error pages: documents that hold what a broken page or an unfilled template left.

Method: sentences (and titles) with a possible residue are cut out and turned into templates, with
names, numbers and paths put aside; records of the same template are aligned by it. A place whose value
differs between aligned records is a slot of the template: a slot that retains a variable name, a
default or a blank is a residue. Filled records count as well: all sentences of all texts are aligned
with the places found (see `fills`), and a sentence that holds words of its own there proves the slot.
A place whose value never differs is part of the wording, as in an article that cites a placeholder,
unless its syntax is that of a template language or its value asks to be filled in; how often a record
is repeated does not matter. Besides, sentences
and titles that are error, blocking, expiry, removal, maintenance or script notices as a whole are told from
sentences of articles by a model of words (see `notices`), fitted on labelled sentences and on counts over all
documents: the texts are read once, the sentences that the labelled ones alone don't surely tell from notices are stored with
their form, words are counted beside, and the stored sentences are judged once the model is fitted. Pages of other wordings and languages are found by their repetition: the templates of whole short texts with a word of
notices (in several languages) or a status number are counted over all documents, and those that stand
in REPEATED documents or more are residues.

Defined results: null text and null title hold nothing; rows without a doc_id are never found; repeated rows give one doc_id; an empty table
gives an empty result. The whole text is searched; only doc_id, text and title are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import notices
from quillon.session import cut
from quillon.skew import join_counted

# Fixed values. STRONG: syntax of template languages and traces of unfilled values, which no prose has.
STRONG = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{0,60}%\}|\$\{[^{}\n]{0,60}\}|#\{[^{}\n]{0,60}\}|<%[^<>\n]{0,60}%>|<\?(?:=|php)[^<>\n]{0,60}\?>"
    r"|<<\w{2,40}>>|%%\w{2,40}%%|%[a-z_]{3,30}%|%[A-Z_]{3,30}%|@@\w{2,40}@@|##\w{2,40}##|\*\|\w{2,40}\|\*|\[\[\s*[\w. ]{2,40}\s*\]\]|__[A-Z][A-Z_]{1,38}__|\$\d_\w{2,30}|\$[A-Z_]{4,30}\b"
    r"|\[object Object\]|\bundefined undefined\b|\bNaN NaN\b|\bnull null\b|&lt;[A-Z_]{3,30}&gt;"
)
# WEAK: marks that prose may hold as well; they count where alignment shows a slot, or by their wording.
WEAK = re.compile(r"\{[A-Za-z_][\w .-]{0,40}\}|\[[^\[\]\n]{2,60}\]|<[A-Za-zÀ-ÿ_][\wÀ-ÿ '_-]{1,40}>|\bX{3,}\b(?:\s*\([^()\n]{2,40}\))?|_{4,}|\.{6,}|\bundefined\b|\bNaN\b|\bN/A\b|\bTBD\b|\bTODO\b|\bFIXME\b|\b(?:à|À) (?:compléter|COMPLÉTER)\b")
DEFAULTS = re.compile(
    r"(?i:^[\[{<(]?\s*(?:votre|vos|your|insérer|inserer|insert|ajouter|add|saisir|enter|à compléter|a completer|à remplir|à définir|to be (?:completed|filled|defined)|placeholder|todo|tbd|xxx+)\b)"
    r"|^[\[{<(]\s*(?:NOM|PRÉNOM|PRENOM|NAME|FIRST NAME|LAST NAME|DATE|TITRE|TITLE|LIEU|PLACE|VILLE|CITY|ADRESSE|ADDRESS|E-?MAIL|TÉLÉPHONE|PHONE|MONTANT|AMOUNT|LIEN|LINK|IMAGE|PHOTO|CITATION|QUOTE|TEXTE|TEXT)\b[^\]}>)a-zà-ÿ]*[\]}>)]$"
)
# Fixed value: the words of filler text.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit laborum vitae turpis sapien ligula justo quam varius nunc porta nibh augue arcu felis orci massa tellus risus pretium pellentesque vestibulum curabitur donec mauris praesent vivamus aliquam phasellus".split()
# Parts of which every mark of STRONG and WEAK, in lower case, holds at least one: what the automaton looks for.
# NaN is looked for by itself, its letters stand in too many words. Notices are told by their own model.
_CLUES = [
    "{", "[", "<", "$", "%%", "@@", "##", "*|", "__", "......", "&lt;", "undefined", "null null", "xxx", "n/a", "tbd", "todo", "fixme", "compléter", "%_", *(f"%{x}" for x in "abcdefghijklmnopqrstuvwxyz"),
]

# the end of the sentence is looked at after its first blank: blanks are found fast
_SENTENCE = re.compile(r"\s(?<=[.!?…»]\s)\s*(?=[«\"(\[{<$%#@*_A-ZÀ-ÖØ-Þ0-9])")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"")
_VARIABLE = re.compile(r"\{[A-Za-z]+(?:_[A-Za-z]+)+\}|<[A-Za-z]+(?:_[A-Za-z]+)+>")
# Features of notices in a short text, whatever its wording.
_FEATURES = re.compile(
    r"(?i)\b(?:[45]\d\d\b|err(?:eur|or)|fehler|fout\b|błąd|ошибк|hata\b|serv(?:er|eur|idor|ice|izio|icio)|dienst|session|sitzung|sesión|sessione|browser|navigat?(?:eur|or|ore)|navegador|javascript|cookies?\b|scripts?\b|captcha|robots?\b|proxy|firewall|login|token"
    r"|(?:in|un)?disponib|unavailable|verfügbar|beschikbaar|introuvable|not found|gefunden|encontrad|trovat[ao]|missing|manquant|expir|abgelaufen|caducad|scadut|accès|access|zugriff|acceso|accesso|toegang|denied|refus|verweiger|denegad|negat[ao]|bloc?[kq]|gesperrt|bloquead"
    r"|requ(?:ête|est)|angefordert|anfrage|solicitud|richiest|maintenance|wartung|mantenimiento|manuten|onderhoud|re(?:charg|load|fresh|try|carg)|réessay|actualis|neu laden|später|timeout|seite|página|pagina|страниц|url|http|link|lien\b|id\b|incident)"
)
_LATIN = frozenset(LATIN)
_LETTERS = re.compile(r"[^\W\d_]+")
_PATH = re.compile(r"\S*[/\\]\S*|\S*\d\S*-\S+|\S+-\S*\d\S*|\S+\.(?:example|php|html?|fr|com|org)\S*")
_NUMBER = re.compile(r"\d[\d\s.,:]*\d|\d")
_GAP = re.compile(r"(?<=\S)\s(?=\S)\W*|^\W+")
_ENDS = re.compile(r"(?<=\w)(?=\W)|(?<=\S)(?=\s|$)")
_NAME = re.compile(r"(?<=[\s(«\"'’])[A-ZÀ-ÖØ-Þ][\w'’-]*(?:[\s-][A-ZÀ-ÖØ-Þ][\w'’-]*)*")


def template(sentence: str) -> str:
    """The sentence with paths, numbers and names put aside; \\x01 is the place looked at."""
    t = _NUMBER.sub("0", _PATH.sub("P", sentence))
    return " ".join(_NAME.sub("N", " " + t).lower().split())


#: Longest filling of a place, in words, and bits of the filters that are sent to the texts (1 MB each, whatever the number of places).
FILL_WORDS, FILTER_BITS = 8, 1 << 23
#: Words by which sentences are searched first; with more of them all sentences are aligned.
ANCHORS, MANY = 100_000, 50
_TOUCHING = re.compile(r"\w*\x01\w*")
_OUTSIDE = re.compile(r"^\W+|\W+$")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _strict(text: str) -> str:
    """As `template`, but the first word stays: any word may stand first with a capital."""
    return " ".join(_NAME.sub("N", _NUMBER.sub("0", _PATH.sub("P", text))).lower().split())


def place_of(before: str, value: str, after: str) -> tuple[int, int, str, str] | None:
    """(hash of the wording before a place, hash of the wording on both sides, the value as bare words, the longest
    words that each aligned sentence holds); None where there is not enough wording to align filled sentences by."""
    t = _strict(WEAK.sub("N", before) + "\x01" + WEAK.sub("N", after))
    words = [w for w in _LETTERS.findall(_TOUCHING.sub(" ", t)) if w not in ("n", "p")]
    if len(words) < 2:
        return None
    words = sorted(set(words), key=lambda w: (-len(w), w))[:3]
    a, b = t.split("\x01")
    return _hash(a), _hash(a + "\x01" + b), _OUTSIDE.sub("", " ".join(value.lower().split())), " ".join(words)


def fillings(text: str, heads: bytes, places: bytes, anchors: dict[str, list[list[str]]], auto: ahocorasick.Automaton | None) -> list[tuple[int, str]]:
    """(hash of a place, filling) of the sentences without a mark; the filters may let other hashes pass."""
    out, mask = [], FILTER_BITS - 1

    def has(bits: bytes, h: int) -> bool:
        return bits[(h & mask) >> 3] >> (h & 7) & 1

    for s in _sentences(text, auto) if auto else all_sentences(text):
        words = set(_LETTERS.findall(s.lower())) if auto else set()
        if auto and not any(len(anchors[w]) > MANY or any(map(words.issuperset, anchors[w])) for w in words.intersection(anchors)):
            continue
        t = _strict(s)
        starts = [0] + [m.end() for m in _GAP.finditer(t)]
        for k, at in enumerate(starts):
            if not has(heads, _hash(t[:at])):
                continue
            for m in _ENDS.finditer(t, at):
                if m.start() > at and has(places, key := _hash(t[:at] + "\x01" + t[m.start() :])):
                    filling = _OUTSIDE.sub("", t[at : m.start()])
                    if filling and len(filling.split()) <= FILL_WORDS and not WEAK.search(s) and not STRONG.search(s):
                        out.append((key, filling))
                if k + FILL_WORDS < len(starts) and m.start() >= starts[k + FILL_WORDS]:
                    break
    return out


def _filter(hashes: DataFrame, column: str) -> bytes:
    """A bit for each hash; combined where the hashes are, so that one fixed size comes to the driver."""
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    rows = hashes.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():
        at = (r["no"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def fills(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(place, least_filling, most_filling): the fillings of the places (head, place, anchor), stored, that some sentence of `docs` holds."""
    words = [r["anchor"] for r in places.select("anchor").distinct().limit(ANCHORS + 1).collect()]
    shared = docs.sparkSession.sparkContext.broadcast((_filter(places, "head"), _filter(places, "place"), words if len(words) <= ANCHORS else []))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, both, words = shared.value
        anchors: dict[str, list[list[str]]] = {}
        for first, *rest in map(str.split, words):
            anchors.setdefault(first, []).append(rest)
        auto = _automaton(list(anchors)) if words else None
        for pdf in pdfs:
            yield pd.DataFrame({r for x in pdf["text"] for r in fillings(x, heads, both, anchors, auto)}, columns=["place", "filling"])

    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("text")
    found = texts.mapInPandas(run, "place long, filling string")
    return found.groupBy("place").agg(F.min("filling").alias("least_filling"), F.max("filling").alias("most_filling"))


def _automaton(phrases: list[str] = _CLUES) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def _sentences(text: str, auto: ahocorasick.Automaton) -> list[str]:
    """The sentences of the text that hold a phrase of the automaton."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out, done = [], -1
    for end, n in auto.iter(low):
        if end - n + 1 < done:
            continue
        at = end - n + 1
        s = text.rfind("\n", 0, at) + 1
        e = text.find("\n", end)
        e = len(text) if e < 0 else e
        line, base = text[s:e], s
        for m in _SENTENCE.finditer(line):
            if base + 0 <= at and s + m.start() <= at:
                base = s + m.end()
            elif s + m.start() > at:
                e = s + m.start()
                break
        base = min(base, at)
        out.append(text[base:e])
        done = e
    return out


def all_sentences(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        if line:
            yield from _SENTENCE.split(line)


def _latin(sentence: str) -> bool:
    words = _LETTERS.findall(sentence.lower())
    return len(words) >= 4 and sum(w in _LATIN for w in words) >= 0.6 * len(words)


#: Whole texts up to PAGE_CHARS characters are pages that may be error templates, in REPEATED documents they are.
PAGE_CHARS, REPEATED = 600, 20
#: Log-odds from which a sentence is a notice.
NOTICE_AT = 2.2
#: What a candidate is by itself: 3 and 2 a residue (3: even without a place), 1 only if its place is a slot, 0 a whole text, if it is repeated;
#: -1 a sentence or title, if the model takes it for a notice, -2 no candidate, but the number of texts that hold a stem.
SURE, LIKELY, OPEN, PAGE, DOUBT, WORDS = 3, 2, 1, 0, -1, -2


Candidate = tuple[str, str, int, int | None, int | None, str | None, str | None]


def doubtful_of(text: str | None, title: str | None, judge: notices.Judge) -> tuple[list[str], set[str]]:
    """(the title and sentences that are not surely no notice, the words of the text)."""
    out, words = [], set()
    for s in set(all_sentences(text or "")):
        said = notices.words_of(s)
        words.update(said)
        if judge.score(s, said) >= notices.SURELY_NOT:
            out.append(s)
    if title and judge.score(title) >= notices.SURELY_NOT and title not in out:
        out.append(title)
    return out, words


def candidates_of(text: str | None, title: str | None, auto: ahocorasick.Automaton) -> list[Candidate]:
    """All possible residues of one document by itself, notices by the labelled sentences alone."""
    judge = notices.Judge(notices.base())
    doubtful, words = doubtful_of(text, title, judge)
    out = marks_of(text, title, auto, words)
    if any(judge.score(s) >= NOTICE_AT for s in doubtful):
        out.append(("notice", "", SURE, None, None, None, None))
    return out


def marks_of(text: str | None, title: str | None, auto: ahocorasick.Automaton, words: set[str]) -> list[Candidate]:
    """(template, value, weight, head, place, bare) of each possible residue but notices; the last four, of `place_of`, only where its weight is OPEN."""
    out: list[Candidate] = []
    if title and (STRONG.search(title) or any(DEFAULTS.match(m.group()) for m in WEAK.finditer(title))):
        out.append(("title", "", SURE, None, None, None, None))
    if not text:
        return out
    if len(text) <= PAGE_CHARS and _FEATURES.search(text):
        out.append((template(text), "", PAGE, None, None, None, None))
    if not _LATIN.isdisjoint(words) and any(map(_latin, all_sentences(text))):
        out.append(("notice", "", SURE, None, None, None, None))
    for s in all_sentences(text) if "NaN" in text else _sentences(text, auto):
        quoted = [m.span() for m in _QUOTED.finditer(s)]
        for pattern, strong in ((STRONG, True), (WEAK, False)):
            for m in pattern.finditer(s):
                a, b = m.span()
                # all blanks are one value, however long
                blank = m.group()[:4] in ("____", "....")
                value = "____" if blank else m.group()
                if not strong and any(x.start() < b and a < x.end() for x in STRONG.finditer(s)):
                    continue
                if strong:
                    weight = SURE
                elif any(q <= a and b <= r for q, r in quoted):
                    weight = OPEN
                else:
                    weight = LIKELY if DEFAULTS.match(value) or _VARIABLE.fullmatch(value) else OPEN
                aligned = template(s[:a] + "\x01" + s[b:])
                # a mark alone has no wording to be aligned by, and numbers in brackets are references
                if weight == OPEN and (len(_LETTERS.findall(aligned)) < 2 or not (blank or _LETTERS.search(value)) or any(ch.isdigit() for ch in value)):
                    continue
                place = place_of(s[:a], value, s[b:]) if weight == OPEN else None
                out.append((aligned, value, weight, *(place or (None, None, None, None))))
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, template, value, weight, head, place, bare, anchor), of one pass over the texts.

    A row of weight DOUBT has the sentence as its template, a hash of its form as head and 1 as place, 0 if the text has said the form
    before; one of weight WORDS a stem of the labelled sentences and the number of texts of a task that hold it ("": of all its texts).
    """
    shared = docs.sparkSession.sparkContext.broadcast(notices.base())

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a word that speaks little for a notice by the labelled sentences may speak more once the model is fitted
        auto, judge, told = _automaton(), notices.Judge(shared.value, clue=0.0), notices.stems()
        in_texts: Counter[str] = Counter()

        def table(rows: list[tuple]) -> pd.DataFrame:
            # as objects, for hashes beside nulls must not pass through floats
            out = pd.DataFrame(rows, columns=["doc_id", "template", "value", "weight", "head", "place", "bare", "anchor"], dtype=object)
            return out.astype({"doc_id": "Int64", "weight": "int32", "head": "Int64", "place": "Int64"})

        for pdf in pdfs:
            rows: list[tuple] = []
            for d, x, t in zip(pdf["doc_id"], pdf["text"], pdf["title"]):
                doubtful, words = doubtful_of(x, t, judge)
                in_texts.update(told.intersection([w[: notices.STEM] for w in words]))
                in_texts[""] += 1
                rows += [(d, *c) for c in marks_of(x, t, auto, words)]
                said: set[int] = set()
                for s in doubtful:
                    form = _hash(notices.form(s))
                    rows.append((d, s, "", DOUBT, form, int(form not in said), None, None))
                    said.add(form)
            yield table(rows)
        yield table([(None, x, "", WORDS, n, None, None, None) for x, n in in_texts.items()])

    return docs.select("doc_id", "text", "title").where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long, template string, value string, weight int, head long, place long, bare string, anchor string")


def model(c: DataFrame) -> dict[str, float]:
    """The model of notices, from the stored candidates of all texts; a text that is stored twice counts twice.

    What stands in COMMON of the documents comes to the driver: few stems, and of doubtful forms at most 1 / COMMON times those of a document.
    """
    stems = {r["template"]: r["n"] for r in c.where(F.col("weight") == WORDS).groupBy("template").agg(F.sum("head").alias("n")).collect()}
    least = max(5.0, notices.COMMON * stems.get("", 0))
    forms = c.where(F.col("weight") == DOUBT).groupBy("head").agg(F.sum("place").alias("n"), F.min("template").alias("sentence"))
    sentences = forms.where(F.col("n") >= least).select("sentence").collect()
    return notices.train(sorted(r["sentence"] for r in sentences), sorted(x for x, n in stems.items() if x and n >= least))


def noticed(c: DataFrame, w: dict[str, float]) -> DataFrame:
    """(doc_id) of the stored doubtful sentences that the model takes for notices."""
    shared = c.sparkSession.sparkContext.broadcast(w)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = notices.Judge(shared.value)
        for pdf in pdfs:
            yield pdf.loc[[judge.score(s) >= NOTICE_AT for s in pdf["template"]], ["doc_id"]]

    return c.where(F.col("weight") == DOUBT).select("doc_id", "template").mapInPandas(run, "doc_id long")


def residues(docs: DataFrame) -> DataFrame:
    """(doc_id): documents with a residue.

    A place is a slot if its template takes two values or more, or if a sentence fills it with words
    other than the value's own.
    """
    c = cut(candidates(docs))
    sure = c.where(F.col("weight") > OPEN).select("doc_id").unionByName(noticed(c, model(c)))
    open_ = c.where(F.col("weight") == OPEN)
    # of a template only the least and the greatest value count: small and combined before the shuffle
    values = cut(c.where(F.length("value") > 0).groupBy("template").agg(F.count("*").alias("records"), F.min("value").alias("least"), F.max("value").alias("most")))
    judged = cut(join_counted(open_, values, ["template"], "records").select("doc_id", "place", "head", "bare", "anchor", (F.col("least") != F.col("most")).alias("slot")))
    unclear = judged.where(~F.col("slot") & F.col("place").isNotNull())
    places = cut(unclear.groupBy("head", "place", "anchor").agg(F.count("*").alias("records")))
    whole = c.where(F.col("weight") == PAGE).select("doc_id", "template").distinct()
    pages = cut(whole.groupBy("template").agg(F.count("*").alias("records")).where(F.col("records") >= REPEATED))
    repeated = join_counted(whole, pages, ["template"], "records").select("doc_id")
    out = sure.unionByName(judged.where("slot").select("doc_id")).unionByName(repeated)
    if places.isEmpty():
        return out.distinct()
    filled = cut(places.drop("head", "anchor").join(fills(docs, places), "place"))
    proved = join_counted(unclear.drop("head", "anchor"), filled, ["place"], "records").where((F.col("least_filling") != F.col("bare")) | (F.col("most_filling") != F.col("bare")))
    return out.unionByName(proved.select("doc_id")).distinct()
