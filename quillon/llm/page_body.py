"""The article of a web page without the page around it.

Method: maximum-scoring subsequence. Each word of a line scores by a learned weight, as do the marks of the
page (separators, arrows, brackets, the line break itself), so words of an article sum up to a positive score
and menus and prompts to a negative one. One linear scan over the page finds the contiguous regions of
the best total; the first is free, each further one costs OPENING, as an article is often interrupted by
the page. No line is judged by itself: a short heading that scores a little below zero stays in its region, a
line that scores a little above zero far from it is left out.

The weights are log-odds (logistic regression) from labelled pages, a bounded sample (SAMPLE pages, the first by
hash of doc_id). Its labels come from what pages repeat, not from wordings: a line is of the page
around if its skeleton (numbers, names and quoted words put aside), or the words it opens with, stand in OFTEN of the
sample's pages or more; it is of the article if it has several sentences, is an item of a list, or
is a line with nothing of the kind repeated (headings). Other lines take no part in the fit; copies of one
article count once. Where few pages are alike in nothing, nothing can be told and no line is left out.

Defined results: null and empty texts have no lines, nor have rows without a doc_id or a kind; blank lines are neither; repeated rows give each
line once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import LOOK
from quillon.llm.sampling import first_by_hash

SAMPLE = 2000
KINDS = ("rss", "site", "page")
#: Share of the sample's pages (and at least five pages) from which a skeleton counts as the page around; below RARE of them it doesn't.
OFTEN, RARE = 0.015, 0.003
OPENING = 1.5
RIDGE = 1e-4

# French and English words without a meaning of their own; they don't make an opening.
SMALL = frozenset(
    """a à au aux avec by ce ces cet cette chez d dans de des du elle elles en est et for from il ils in is je l la le les leur mais n ne
    nous of on or ou par pas pour que qui s sa se ses son sous sur the to un une vers vous y""".split()
)
# Separators and other marks of pages, as they are written once accents and signs are folded.
_SIGNS = {"·": "|", "›": ">", "»": ">", "→": ">", "►": ">", "▶": ">", "➜": ">", "«": '"', "“": '"', "”": '"', "•": "*", "‣": "*", "–": "-", "—": "-", "−": "-", "’": "'", "‘": "'", "…": ".", "©": "@", "\xa0": " ", " ": " ", " ": " "}


class _Folds(dict):
    """What a character beyond ASCII is folded to, found out once."""

    def __missing__(self, ch: str) -> str:
        out = _SIGNS.get(ch) or LOOK.get(ch) or unicodedata.normalize("NFKD", ch).translate(LOOK_TABLE).encode("ascii", "ignore").decode()
        self[ch] = out
        return out


LOOK_TABLE = str.maketrans(LOOK)
_FOLDS = _Folds()
_BEYOND = re.compile("[^\x00-\x7f]")
_NUMBER = re.compile(r"\d(?:[\d .,:]*\d)?")
_TOKEN = re.compile(r"[a-z']+|[^\sa-z']")
_BULLET = re.compile(r"^\s*(?:[-–—•*·‣]\s+|\d+[.)]\s+)\w")
_SENTENCE_END = re.compile(r"(?<=[\w»\")])(?<!\d)[.!?…](?:\s|$)")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"")
_NAME = re.compile(r"\b[A-ZÀ-ÖØ-Þ][\w’'-]*(?:\s+(?:(?:de|du|des|la|le|l'|d')\s*)*[A-ZÀ-ÖØ-Þ][\w’'-]*)*")
_SEPARATORS = frozenset("|/>[]@")


def fold(text: str) -> str:
    """Lower case ASCII: compatibility forms, look-alikes, signs and accents put aside; line feeds stay."""
    if not text.isascii():
        text = _BEYOND.sub(lambda m: _FOLDS[m[0]], text)
    return text.lower()


def _tokens(folded: str) -> list[str]:
    return _TOKEN.findall(_NUMBER.sub("0", folded))


def _masked(text: str) -> list[str]:
    """Tokens without the month of a date."""
    toks = _tokens(fold(text))
    return [x for i, x in enumerate(toks) if not (0 < i < len(toks) - 1 and toks[i - 1] == toks[i + 1] == "0" and x.isalpha())]


def features(folded: str) -> list[str]:
    """Words and marks of a folded line; those it opens and ends with are told apart."""
    toks = _tokens(folded)
    if not toks:
        return ["<none>"]
    n = len(toks)
    size = "<1>" if n == 1 else "<2-3>" if n < 4 else "<4-8>" if n < 9 else "<9-20>" if n < 21 else "<21->"
    toks += ["^" + toks[0], "^" + " ".join(toks[:2]), "^" + " ".join(toks[:3]), "$" + toks[-1], size]
    return toks


def _said(toks: list[str]) -> int:
    """How much a line's opening says: words with a meaning and marks; a mark in the first place says most."""
    return sum(2 if i == 0 and x in ">@[" else 1 for i, x in enumerate(toks) if x in _SEPARATORS or x in ":(" or (len(x) > 1 and x not in SMALL and x[0].isalpha()))


def skeletons(line: str) -> tuple[list[str], list[str]]:
    """(the line without numbers, names and quoted words, once with its first word and once without if that may be a name;
    its openings of two to four tokens that say something)."""
    t = _QUOTED.sub(" q ", line.strip())
    first = re.match(r"\W*\w+", t)
    head = first.end() if first else 0
    kept, bare = _masked(t[:head] + _NAME.sub(" N ", t[head:])), _masked(_NAME.sub(" N ", t))
    both = [kept] if kept == bare else [kept, bare]
    return [" ".join(x) for x in both if _said(x)], [" ".join(x[:k]) for x in both for k in range(1, min(4, len(x)) + 1) if _said(x[:k]) >= 2]


def labelled(texts: list[str | None], often: float = OFTEN, rare: float = RARE) -> list[tuple[str, bool]]:
    """(line, whether it is of the article) of the lines of a sample of pages that can be labelled."""
    pages: dict[str, int] = {}
    lines: list[tuple[str, list[str], list[str]]] = []
    # copies and versions of one article repeat its lines as well: pages with the same longest line count once
    once = {max(text.split("\n"), key=len): text for text in texts if text}
    for text in once.values():
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip():
                whole, opening = skeletons(line)
                lines.append((line, whole, opening))
                seen.update(["=" + x for x in whole])
                seen.update(opening)
        for s in seen:
            pages[s] = pages.get(s, 0) + 1
    many, few = max(5.0, often * len(once)), max(2.0, rare * len(once))
    out = []
    for line, whole, opening in lines:
        n_sentences, n_words = len(_SENTENCE_END.findall(line)), len(line.split())
        same = max((pages["=" + x] for x in whole), default=0)
        most = max((pages[x] for x in opening), default=0)
        if same >= many:
            out.append((line, False))
        elif line.upper() == line and n_words > 1:
            continue  # names cannot be told in capitals
        elif n_sentences >= 2 and len(line) > 150 or n_sentences and len(line) > 250 or _BULLET.match(line):
            out.append((line, True))
        elif most >= many:
            # one long sentence of an article may open as others do
            if not (n_sentences and n_words >= 12):
                out.append((line, False))
        elif most <= few and n_words >= 4 and ":" not in line and not _SEPARATORS.intersection(fold(line)):
            out.append((line, True))
    return out


def train(texts: list[str | None], rounds: int = 200) -> dict[str, float]:
    """Weights of words and marks: log-odds of article against page, a logistic regression over the labelled lines; "" is the line break's."""
    names: dict[str, int] = {}
    ids, rows, y = [], [], []
    for line, is_article in dict.fromkeys(labelled(texts)):
        got = {names.setdefault(f, len(names)) for f in features(fold(line))}
        ids += got
        rows += [len(y)] * len(got)
        y.append(is_article)
    if not y:
        return {}
    i, r, t = np.array(ids), np.array(rows), np.array(y, float)
    # both kinds of lines have the same say
    share = np.where(t > 0, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))
    w, bias = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(r, w[i], len(t)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * share
        g = np.r_[np.bincount(i, d[r], len(w)) + RIDGE * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return {"": round(float(bias), 4)} | {f: round(float(w[k]), 4) for f, k in names.items()}


def weights(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most `sample` pages, the first by hash of doc_id."""
    rows = first_by_hash(docs.where(F.col("kind").isin(*KINDS)).select("doc_id", "text"), "doc_id", sample)
    return train([r["text"] for r in rows])


def line_score(folded: str, w: dict[str, float]) -> float:
    """The sum of a folded line's words and marks, each counted once."""
    return w.get("", 0.0) + sum(map(w.__getitem__, w.keys() & features(folded)))


def best_regions(scores: list[float], opening: float = OPENING) -> list[tuple[int, int]]:
    """(start, end) of the contiguous regions whose scores sum up to the most, less `opening` for each region after the first.

    One scan forth, which keeps the best total before any region, within one and after one, and one back along its choices.
    """
    before, inside, after = 0.0, float("-inf"), float("-inf")
    steps: list[tuple[int, int]] = []
    for s in scores:
        # where `inside` and `after` come from: 0 before, 1 inside, 2 after
        came = max(((before, 0), (inside, 1), (after - opening, 2)), key=lambda x: x[0])
        left = (inside, 1) if inside > after else (after, 2)
        steps.append((came[1], left[1]))
        inside, after = came[0] + s, left[0]
    state = max(((before, 0), (inside, 1), (after, 2)), key=lambda x: x[0])[1]
    out, end = [], None
    for i in range(len(scores) - 1, -1, -1):
        if state == 1:
            end = i + 1 if end is None else end
            state = steps[i][0]
            if state != 1:
                out.append((i, end))
                end = None
        elif state == 2:
            state = steps[i][1]
        else:
            break
    return out[::-1]


class Scorer:
    """Lines in, those around the article out; short lines are scored once a task, as pages repeat them."""

    def __init__(self, w: dict[str, float]):
        self.w = w
        self.known: dict[str, float] = {}

    def score(self, folded: str) -> float:
        if len(folded) > 120:
            return line_score(folded, self.w)
        s = self.known.get(folded)
        if s is None:
            s = line_score(folded, self.w)
            if len(self.known) < 100_000:
                self.known[folded] = s
        return s

    def page_lines(self, text: str) -> list[int]:
        """Numbers, from 1, of the non-blank lines that are not the article."""
        lines, folded = text.split("\n"), fold(text).split("\n")
        at = [i for i, line in enumerate(lines) if line.strip()]
        article = set()
        for a, b in best_regions([self.score(folded[i].strip()) for i in at]):
            article.update(at[a:b])
        return [i + 1 for i in at if i not in article]


def page_lines(text: str, w: dict[str, float]) -> list[int]:
    return Scorer(w).page_lines(text)


def _pages(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("kind").isin(*KINDS) & F.col("doc_id").isNotNull()).select("doc_id", "text")


def around(docs: DataFrame, w: dict[str, float]) -> DataFrame:
    """(doc_id, line_no): the lines around the article of each web page (kinds KINDS)."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(shared.value)
        for pdf in pdfs:
            rows = [(d, n) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for n in s.page_lines(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no"])

    return _pages(docs).mapInPandas(run, "doc_id long, line_no int")


def bodies(docs: DataFrame, w: dict[str, float]) -> DataFrame:
    """(doc_id, n_removed, text): each web page freed of the lines around its article; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def body(s: Scorer, text: str | None) -> tuple[int, str | None]:
        drop = set(s.page_lines(text)) if text else ()
        return len(drop), "\n".join([x for n, x in enumerate(text.split("\n"), 1) if n not in drop]) if drop else text

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(shared.value)
        for pdf in pdfs:
            got = [body(s, t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_removed": [g[0] for g in got], "text": [g[1] for g in got]})

    return _pages(docs).mapInPandas(run, "doc_id long, n_removed int, text string")
