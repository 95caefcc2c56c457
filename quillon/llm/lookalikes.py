"""Visually identical text in one consistent form.

Method: compatibility normalization (NFKC), deletion of ignorable characters, plain spaces; then each
word that mixes Latin with another script is a lattice of look-alike characters, in both directions (a Latin letter
may stand for one of the other script as well), searched with Viterbi under character bigram scores. The
bigrams are counted over all rows (both scripts as they stand in words of one script), a step between
scripts costs SWITCH, and each character that is changed costs CHANGE. A word that mixes Latin with
look-alikes is found even where no other form is better.

Defined results: null stays null, empty stays empty; rows without an id are left out; line feeds, tabs and carriage returns are kept;
words wholly in one script, French quotation marks, dashes and curly apostrophes are kept; a repeated
row gives a repeated result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points below this take part in the character model (Latin, Greek, Cyrillic, Armenian).
ALPHABET = 0x590
SWITCH, CHANGE = 9.0, 1.0

# Letters of other scripts and the Latin letters they look like.
LOOK = dict(zip(
    "аеорсухіјѕԁһԛԝӏѵьгпкмтнвАВЕЗКМНОРСТУХІЈЅԌҺԚԜӀѴ"
    "αοενιυρκτηγωχβζμςδΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳϲ"
    "օոսհզցՕՍԼ",
    "aeopcyxijsdhqwlvbrnkmtHBABE3KMHOPCTYXIJSGhQWIV"
    "aoevuupkTnywxBzucdABEZHIKMNOPTYXCjc"
    "onuhqgOUL",
    strict=True,
))

SPACES = "\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
IGNORABLE = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff"
_SPACE, _IGNORE = re.compile(f"[{SPACES}]"), re.compile(f"[{IGNORABLE}]")
_OTHER = re.compile("[Ͱ-֏Ꭰ-᏿Ⲁ-⳿]")
#: Words with their elisions, as in l'été; the apostrophe parts no word from its article.
_WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")


def base_form(text: str) -> str:
    """Compatibility-normalized, without ignorable characters, with plain spaces."""
    if text.isascii():
        return text
    t = _SPACE.sub(" ", _IGNORE.sub("", text))
    return t if unicodedata.is_normalized("NFKC", t) else _SPACE.sub(" ", _IGNORE.sub("", unicodedata.normalize("NFKC", t)))


def _script(cp: int) -> int:
    """1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian, 0 no letter, 5 any other."""
    ch = chr(cp)
    if not ch.isalpha():
        return 0
    if cp < 0x370:
        return 1
    return 2 if cp < 0x400 else 3 if cp < 0x530 else 4 if cp < 0x590 else 5


_SCRIPTS = np.array([_script(cp) for cp in range(ALPHABET)], np.uint8)


def _pairs(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of pairs of letters of one script, of a batch of text."""
    for pdf in pdfs:
        texts = [t for t in pdf["text"] if t]
        raw = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
        cp = np.where(raw < ALPHABET, raw, 0).astype(np.int32)
        script = _SCRIPTS[cp]
        # 0 stands for the edge of a word
        cp[script == 0] = 0
        a, b, sa, sb = cp[:-1], cp[1:], script[:-1], script[1:]
        ok = ((sa == sb) | (sa == 0) | (sb == 0)) & ((a != 0) | (b != 0))
        n = np.bincount(a[ok] * ALPHABET + b[ok], minlength=1)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"pair": at, "n": n[at]})


def pair_counts(texts: DataFrame) -> dict[tuple[int, int], int]:
    """Pairs of characters over all rows of `texts` (text); at most ALPHABET**2 numbers, in practice some thousand."""
    rows = texts.select("text").mapInPandas(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {divmod(r["pair"], ALPHABET): r["n"] for r in rows}


def _back() -> dict[int, dict[str, list[str]]]:
    """For each other script, the letters that a Latin letter may stand for."""
    out: dict[int, dict[str, list[str]]] = {}
    for other, latin in LOOK.items():
        out.setdefault(int(_SCRIPTS[ord(other)]) if ord(other) < ALPHABET else 5, {}).setdefault(latin, []).append(other)
    return out


BACK = _back()


class Lattice:
    """Viterbi search of a word's look-alikes under the counted bigrams."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        self.counts = counts
        self.sums: dict[int, int] = {}
        for (a, _), n in counts.items():
            self.sums[a] = self.sums.get(a, 0) + n
        self.known: dict[str, str] = {}

    def step(self, a: str, b: str) -> float:
        x, y = ord(a.lower()[:1] or "\0"), ord(b.lower()[:1] or "\0")
        s = math.log((self.counts.get((x, y), 0) + 0.5) / (self.sums.get(x, 0) + 0.5 * 200))
        p, q = (_SCRIPTS[c] if c < ALPHABET else 5 for c in (x, y))
        return s - (SWITCH if p and q and p != q else 0.0)

    def best(self, word: str) -> str:
        if word in self.known:
            return self.known[word]
        scripts = {int(_SCRIPTS[ord(c)]) for c in word if c in LOOK and ord(c) < ALPHABET}
        options = [{c, LOOK.get(c, c), *(o for k in scripts for o in BACK[k].get(c, ()))} for c in word]
        paths = {"\0": (0.0, "")}
        for i, choice in enumerate(options):
            paths = {
                c: max(((s + self.step(p, c) - (CHANGE if c != word[i] else 0.0), w + c) for p, (s, w) in paths.items()), key=lambda x: (x[0], x[1]))
                for c in sorted(choice)
            }
        out = max(((s + self.step(p, "\0"), w) for p, (s, w) in paths.items()), key=lambda x: (x[0], x[1]))[1]
        if len(self.known) < 200_000:
            self.known[word] = out
        return out

    def clean(self, text: str) -> str:
        return self.judged(text)[0]

    def judged(self, text: str) -> tuple[str, bool]:
        """(the text in its consistent form, whether it had any other)."""
        t = base_form(text)
        if not _OTHER.search(t):
            return t, t != text
        mixed = False

        def word(m: re.Match) -> str:
            nonlocal mixed
            w = m.group()
            if not _OTHER.search(w) or all(_OTHER.match(c) or not c.isalpha() for c in w):
                return w
            mixed = mixed or any(c in LOOK for c in w)
            return self.best(w)

        out = _WORD.sub(word, t)
        return out, mixed or out != text


def consistent(rows: DataFrame, id_col: str, text_col: str, counts: dict[tuple[int, int], int], only_changed: bool = False) -> DataFrame:
    """(id, text, changed): the rows' text in its consistent form; with `only_changed`, the changed rows only."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(counts)
        for pdf in pdfs:
            new = [(None, False) if t is None else lattice.judged(t) for t in pdf["text"]]
            pdf["changed"], pdf["text"] = [x[1] for x in new], [x[0] for x in new]
            yield pdf[pdf["changed"]] if only_changed else pdf

    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).mapInPandas(run, "id long, text string, changed boolean")
