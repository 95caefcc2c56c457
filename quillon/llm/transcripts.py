"""Clean speaker turns from caption lines and from pieces of speech.

Method: one Aho-Corasick automaton holds every spelling of every voice's label, the hesitation sounds
and the words of sound notes. Context rules decide what a match is (a name is a label only at the
beginning of a line, after a time mark, and before its delimiter; a hesitation sound must stand as a
word; a note must stand in its brackets), the matched intervals are subtracted from the line, and
windows build the turns. The windows run in two levels (within stretches of time, then over the
stretches of a video), so that a video with a large share of all rows is spread over many tasks.

Defined results: a null line, an empty one, or one of labels, times, tags, hesitations and notes only
yields no words, its label still names the voice; before the first label the speaker is null; rows
with equal (video_id, number) count once (the one least in order), those without either are left out; an empty table gives no turns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Hesitation sounds and words of sound notes (folded: lower case, no accents).
HESITATIONS = ["beuh", "euh", "euuh", "euuuh", "ehm", "heu", "heuh", "heuu", "hm", "hmm", "hum", "humm", "mh", "mhm", "mm", "mmh", "mmm", "mmhm", "pff", "pfff", "uh", "uhm"]
NOTES = ["acclamation", "ambiance", "applaud", "applause", "bruit", "brouhaha", "chant", "chuchot", "coupure", "cri", "exclamation", "fond sonore", "generique", "grincement", "huee", "hors micro", "inaudible", "incomprehensible", "interruption", "jingle", "laugh", "micro", "murmure", "music", "musique", "noise", "pause", "protestation", "respiration", "rire", "sifflet", "silence", "sonnerie", "soupir", "sourire", "toux", "tousse", "vivats"]

# Words that stand beside those of a sound note (folded).
BESIDE = frozenset(
    """a and assemblee au audience dans aux background banc bancs breve breves bref brefs centre commission continu coupe coupes court de des deux divers
    droite du en et exterieur extreme faible fond fort forte fortes forts gauche general generaux groupe hemicycle hors in l la le leger legere les long longs longue
    longues loud mouvement mouvements nourri nourris of off on par plusieurs prolonge prolongee prolonges public puis quelques salle sonore soutenu soutenus sur the tres
    tribune tribunes un une vif vifs vive vives voix""".split()
)

_TIME = (
    r"\[\d+h\d+m\d+s\]"
    r"|\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\s*-->(?:\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?)?"
    r"|(?:[\[(<]\s*)?\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s*[\])>])?"
    r"|[\[(<]\s*\d{1,3}:\d{2}(?:[.,]\d+)?\s*[\])>]"
    r"|\b\d{1,3}'\d{2}''|\b\d{1,3}['′]\d{2}(?:\"|″)"
)
TIME = re.compile(_TIME)
LEAD = re.compile(rf"(?:{_TIME}|\s+|>>+|-(?!->)|–|—|•|<(?!v\b|/)[^<>]*>|</[^<>]*>|\*\*|[♪♫])*")
BRACKETS = re.compile(r"\[[^\[\]]*\]|\{[^{}]*\}|[♪♫][^♪♫]*[♪♫]|(?<!\*)\*(?!\*)[^*]+\*(?!\*)|<[^<>]*>|\([^()]*\)")
TAG = re.compile(r"</?(?:[a-z][\w.]{0,8}|v\s[^<>]*|\d[\d:.,]*)>")
WORD = re.compile(r"[^\W_]")


_FOLDED_WORD = re.compile(r"[^\W\d_]+")
_STEMS = sorted({w for n in NOTES for w in n.split() if len(w) > 2}, key=len)


def is_note(folded: str) -> bool:
    """Whether words in parentheses name a sound: each is a word of notes, or one that stands beside them; short ones only with a plain ending."""
    words = _FOLDED_WORD.findall(folded)
    named = False
    for w in words:
        if any(w.startswith(n) and (len(n) > 5 or w[len(n) :] in ("", "s", "e", "es", "x", "er", "ter", "ing", "ment", "ments")) for n in _STEMS):
            named = True
        elif w not in BESIDE:
            return False
    return named


def fold(text: str) -> str:
    """Lower case without accents; every character stays one character, so positions hold."""
    if text.isascii():
        return text.lower()
    out = []
    for ch in text:
        c = unicodedata.normalize("NFD", ch)[0].lower()
        out.append(c if len(c) == 1 else ch)
    return "".join(out)


def voice_spellings(full_name: str, honorific: str | None) -> list[str]:
    """The folded spellings under which a voice is named: full, family name, initial, with the honorific."""
    full = fold(" ".join(full_name.split()))
    first, _, last = full.partition(" ")
    last = last or first
    names = {full, last, f"{first[0]}. {last}", f"{last} {first}"}
    titles = [fold(honorific)] if honorific else []
    titles += ["m.", "mme", "mme.", "monsieur", "madame"]
    return sorted(names | {f"{t} {n}" for t in titles for n in (full, last)})


class Cleaner:
    """The automaton of one set of voices; `clean` gives (voice of the label or None, words)."""

    def __init__(self, voices: list[tuple[str, str, str | None]]):
        auto = ahocorasick.Automaton()
        items: dict[str, list] = {}
        for voice_id, full_name, honorific in voices:
            if full_name:
                for s in voice_spellings(full_name, honorific):
                    items.setdefault(s, []).append(("label", voice_id))
        for s in HESITATIONS:
            items.setdefault(s, []).append(("sound", None))
        for s in NOTES:
            items.setdefault(s, []).append(("note", None))
        for s, kinds in items.items():
            auto.add_word(s, (len(s), kinds))
        auto.make_automaton()
        self.auto = auto

    @staticmethod
    def _label_end(text: str, start: int, end: int, begin: int) -> int | None:
        """Where the label that names text[start:end] ends, if that is a label; begin: where the lead ends."""
        before, rest = text[begin:start], text[end:]
        if before == "[" and rest.startswith("]"):
            m = re.match(r"\]\s*[:–—-]?", rest)
            return end + m.end()
        if re.fullmatch(r"<v(?:\.[\w.]+)?\s+", before) and rest.startswith(">"):
            return end + 1
        if before == "":
            m = re.match(r"\.?\s*(?:\([^()]+\)|,\s*[^:–—.!?]{1,120})?\s*(?:\*\*)?\s*(?::|\.?\s*[–—]|\s-\s)(?:\s*\*\*)?", rest)
            if m:
                return end + m.end()
        return None

    def clean(self, line: str | None) -> tuple[str | None, str]:
        if not line:
            return None, ""
        folded = fold(line)
        begin = LEAD.match(line).end()
        marks, notes, cuts, voice = [], [], [(0, begin)], None
        best = None
        for last, (n, kinds) in self.auto.iter(folded):
            s, e = last - n + 1, last + 1
            for kind, who in kinds:
                if kind == "label":
                    if s >= begin and (best is None or s < best[0] or (s == best[0] and e > best[1])):
                        to = self._label_end(line, s, e, begin)
                        if to is not None:
                            best = (s, e, to, who)
                elif kind == "note":
                    notes.append(s)
                elif (s == 0 or not (folded[s - 1].isalnum() or folded[s - 1] in "'’-")) and (e == len(folded) or not (folded[e].isalnum() or folded[e] in "'’-")):
                    marks.append((s, e))
        if best:
            voice = best[3]
            cuts.append((begin, best[2]))
        for m in TIME.finditer(line):
            cuts.append(m.span())
        for m in BRACKETS.finditer(line):
            s, e = m.span()
            if line[s] == "(" and not (any(s <= k < e for k in notes) and is_note(folded[s + 1 : e - 1])):
                continue  # words in parentheses are spoken unless they name nothing but a sound
            cuts.append((s, e))
        for s, e in marks:
            while e < len(line) and line[e] in ".,…":
                e += 1
            cuts.append((s, e))
        out, at = [], 0
        for s, e in sorted(cuts):
            if s > at:
                out.append(line[at:s])
                # a tag inside a word does not part it
                if not (line[s] == "<" and TAG.fullmatch(line[s:e])):
                    out.append(" ")
            at = max(at, e)
        out.append(line[at:])
        words = " ".join("".join(out).split())
        return voice, words if WORD.search(words) else ""


def _cleaned(voices: list[tuple[str, str, str | None]], text: str):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Cleaner(voices)
        for pdf in pdfs:
            got = [c.clean(x) for x in pdf[text]]
            pdf["label"], pdf["words"] = [g[0] for g in got], [g[1] for g in got]
            yield pdf[["video_id", "at", "no", "label", "words"]]

    return run


_PIECES = "video_id long, at double, no int, label string, words string"


def cue_pieces(cues: DataFrame, voices: DataFrame, max_voices: int = 100_000) -> DataFrame:
    """(video_id, at, no, label, words) of caption lines; the voices must be at most `max_voices` rows."""
    known = [tuple(r) for r in voices.select("voice_id", "full_name", "honorific").limit(max_voices + 1).collect()]
    if len(known) > max_voices:
        raise ValueError(f"more than {max_voices} voices")
    rows = cues.select("video_id", F.col("t").cast("double").alias("at"), F.col("seq").alias("no"), "line")
    once = rows.where(F.col("video_id").isNotNull() & F.col("no").isNotNull()).groupBy("video_id", "no").agg(F.min(F.struct("at", "line")).alias("x")).select("video_id", "x.at", "no", "x.line")
    return once.mapInPandas(_cleaned(known, "line"), _PIECES)


def turn_pieces(turns: DataFrame) -> DataFrame:
    """The same of pieces of speech; the label is the voice number without leading zeros."""
    rows = turns.select("video_id", F.col("start_s").alias("at"), F.col("turn_no").alias("no"), "speaker", "text")
    once = rows.where(F.col("video_id").isNotNull() & F.col("no").isNotNull()).groupBy("video_id", "no").agg(F.min(F.struct("at", "speaker", "text")).alias("x")).select("video_id", "x.at", "no", "x.speaker", "x.text")
    number = F.regexp_extract(F.coalesce("speaker", F.lit("")), r"(\d+)\D*$", 1)
    label = F.when(number != "", F.regexp_replace(number, r"^0+(?=\d)", ""))
    named = once.select("video_id", "at", "no", label.alias("who"), "text")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Cleaner([])
        for pdf in pdfs:
            pdf["words"] = [c.clean(x)[1] for x in pdf["text"]]
            pdf["label"] = pdf["who"]
            yield pdf[["video_id", "at", "no", "label", "words"]]

    return named.mapInPandas(run, _PIECES)


def _spoken(pieces: DataFrame, stretch_s: float) -> DataFrame:
    """The pieces with words: (video_id, stretch, at, no, words, speaker, starts), starts = 1 where a turn begins.

    Level one works within stretches of `stretch_s` seconds, level two over one row per stretch, so
    no task holds a whole video. Pieces without a time go before the others.
    """
    p = pieces.select("video_id", "at", "no", "label", "words", F.coalesce(F.floor(F.col("at") / stretch_s), F.lit(-(2**40))).cast("long").alias("stretch"))
    inside = W.partitionBy("video_id", "stretch").orderBy(F.col("at").asc_nulls_first(), F.col("no"))
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("own", F.last("label", ignorenulls=True).over(so_far)).withColumn("spoken", F.col("words") != "")
    when = F.coalesce("at", F.lit(-1e300)).alias("k")
    ends = p.groupBy("video_id", "stretch").agg(
        F.max(F.when(F.col("label").isNotNull(), F.struct(when, "no", "label"))).getField("label").alias("last_label"),
        F.max(F.when(F.col("spoken"), F.struct(when, "no", "own"))).alias("last_spoken"),
    )
    over = W.partitionBy("video_id").orderBy("stretch")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.last("last_label", ignorenulls=True).over(earlier))
    ends = ends.withColumn("voice_at_end", F.when(F.col("last_spoken").isNotNull(), F.struct(F.coalesce("last_spoken.own", "carried").alias("who"))))
    ends = ends.select("video_id", "stretch", "carried", F.last("voice_at_end", ignorenulls=True).over(earlier).alias("before"))
    q = p.where("spoken").join(ends, ["video_id", "stretch"]).select("video_id", "stretch", "at", "no", "words", F.coalesce("own", "carried").alias("speaker"), "before")
    prev = F.coalesce(F.lag(F.struct(F.col("speaker").alias("who"))).over(inside), F.col("before"))
    return q.withColumn("starts", (prev.isNull() | ~prev.getField("who").eqNullSafe(F.col("speaker"))).cast("int")).drop("before")


def turn_starts(pieces: DataFrame, stretch_s: float = 3600.0) -> DataFrame:
    """(video_id, start_no, speaker): one row per turn."""
    return _spoken(pieces, stretch_s).where("starts = 1").select("video_id", F.col("no").alias("start_no"), "speaker")


def clean_turns(pieces: DataFrame, stretch_s: float = 3600.0) -> DataFrame:
    """(video_id, turn, part, speaker, start_no, text): each turn's words; a turn that runs over several stretches has one part in each."""
    q = _spoken(pieces, stretch_s)
    inside = W.partitionBy("video_id", "stretch").orderBy(F.col("at").asc_nulls_first(), F.col("no"))
    q = q.withColumn("k", F.sum("starts").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    earlier = W.partitionBy("video_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    base = q.groupBy("video_id", "stretch").agg(F.sum("starts").alias("n")).select("video_id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    said = F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(-1e300)).alias("k"), "no", "words")))
    parts = q.join(base, ["video_id", "stretch"]).groupBy("video_id", (F.col("k") + F.col("base")).alias("turn"), "stretch").agg(said.alias("said"), F.first("speaker").alias("speaker"))
    part = F.row_number().over(W.partitionBy("video_id", "turn").orderBy("stretch"))
    return parts.select("video_id", "turn", part.alias("part"), "speaker", F.col("said")[0]["no"].alias("start_no"), F.array_join(F.transform("said", lambda s: s["words"]), " ").alias("text"))
