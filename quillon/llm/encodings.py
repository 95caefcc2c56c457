"""Text that was decoded with the wrong encoding, and its original.

Method: a multinomial classifier over hashed byte bigrams of words, trained on words garbled on
purpose by each chain of encodings, predicts the exact chain; the chain is inverted and the result
counts only if it decodes strictly and reads more like clean text. Where characters were lost
(replacement characters) the place is found, but nothing is recovered.

The classifier is fitted on a bounded sample: the words of the `sample` documents (SAMPLE by default)
that come first by hash, without those that invert under a UTF-8 chain, besides a fixed list of
foreign names. Everything else covers every word of every row.

Defined results: null and empty texts are clean and stay as they are; rows without a doc_id are left out; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalikes import LOOK, base_form
from quillon.llm.sampling import first_by_hash

SAMPLE = 400
HASHED = 1 << 14

# Single-byte encodings in use, and foreign names that are not garbled.
WRONG = ["cp1252", "latin-1", "iso8859-15", "cp1251", "cp1250", "iso8859-2", "iso8859-9", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp1253", "cp1254", "cp1257"]
SINGLE = ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250"]
NAMES = """São João Gonçalves Ângela Ávila Évora Ítalo Óscar Úrsula Ñusta Muñoz Peña Zürich Müller Köln Größe Straße
Äänekoski Öland Ås Åland Ærø Øresund Þórður Łódź Wałęsa Kraków Dvořák Čapek Škoda Žižek Đoković Győr Őrség Erdoğan İzmir
Şişli Çelik Ștefan Brașov Țara España Málaga Čech Aïnhoa Loïc Noël Gaëlle Zoë Haÿ Œuvre Æsir Curaçao Besançon
Nîmes Saône Rhône Béarn Âge Île Ô Où ŒUVRE ÉTÉ ÇA ÀÉÈÊ SÃO JOÃO MÜNCHEN GRÜN ÎLE HÔPITAL NOËL coração Avião pães ções""".split()


def _wrong(data: bytes, enc: str) -> str:
    """Decoding as lenient programs do it: bytes that the encoding leaves out become control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _back(text: str, enc: str) -> bytes:
    """The bytes that `_wrong` read; strict but for the control characters it lets through."""
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(enc)
        except UnicodeEncodeError:
            if ord(ch) > 0xFF or not 0x80 <= ord(ch) < 0xA0:
                raise
            out.append(ord(ch))
    return bytes(out)


def chains() -> list[tuple[tuple[str, str], ...]]:
    """Each chain is a list of steps (encoded as, decoded as); the empty chain is clean text."""
    out: list[tuple[tuple[str, str], ...]] = [()]
    out += [(("utf-8", w),) for w in WRONG]
    out += [(("utf-8", w),) * k for w in ("cp1252", "latin-1", "iso8859-15", "cp850", "mac_roman", "cp437", "cp1251") for k in (2, 3)]
    out += [(("utf-8", "latin-1"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "latin-1"))]
    out += [((a, b),) for a in SINGLE for b in [*SINGLE, "latin-1"] if a != b and {a, b} != {"cp1252", "latin-1"}]
    return out


CHAINS = chains()


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for enc, wrong in chain:
        try:
            text = _wrong(text.encode(enc), wrong)
        except UnicodeEncodeError:
            return None
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, or None if it isn't strictly decodable."""
    try:
        for enc, wrong in reversed(chain):
            text = _back(text, wrong).decode(enc)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    return text


TOKEN = re.compile(r"[^ \n\t\r]*[^\x00-\x7f ][^ \n\t\r]*")
_PLAIN = re.compile(r"[\x20-\x7eàâäçéèêëîïôöùûüÿœæÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŸŒÆ«»‘’“”–—·•→©]+")
_MIXED_CASE = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff\u0153][\u00c0-\u00d6\u00d8-\u00de\u0152\u0178]")


def _bigrams(word: str) -> np.ndarray:
    b = np.frombuffer(b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint32)
    h = (b[:-1] << np.uint32(8)) | b[1:]
    h = (h * np.uint32(2654435761)) >> np.uint32(16)
    # bigrams of two ASCII bytes say nothing about the chain
    use = (b[:-1] >= 0x80) | (b[1:] >= 0x80)
    return (h[use] % HASHED).astype(np.int64)


_EDGES = re.compile(r"^\W+|\W+$")


def _core(word: str) -> str:
    """A word without what stands around it and without what is elided before it."""
    return _EDGES.sub("", word.lower().replace("\u2019", "'")).rpartition("'")[2]


class Model:
    """Multinomial naive Bayes over hashed byte bigrams; one class a chain."""

    def __init__(self, words: list[str]):
        clean = sorted({w for w in words} | {w.upper() for w in words if len(w) > 1} | {w.capitalize() for w in words} | set(NAMES))
        counts = np.full((len(CHAINS), HASHED), 0.02, np.float64)
        for k, chain in enumerate(CHAINS):
            for w in clean:
                g = garble(w, chain)
                if g is not None and (not chain or g != w):
                    np.add.at(counts[k], _bigrams(g), 1.0)
        self.log = (np.log(counts) - np.log(counts.sum(1, keepdims=True))).astype(np.float32)
        self.clean_bigrams = counts[0] > 0.5
        self.vocabulary = {_core(w) for w in clean}
        self.letters = {w for w in clean if len(w) == 1 and w.isalpha()}

    def ranked(self, word: str) -> list[int]:
        """All chains, the likeliest first."""
        f = _bigrams(word)
        return np.argsort(-self.log[:, f].sum(1), kind="stable").tolist() if len(f) else [0]

    def fit_of(self, word: str) -> float:
        f = _bigrams(word)
        return float(self.log[0, f].mean()) if len(f) else 0.0


class Detector:
    """Words in, originals out; known words are kept, as texts repeat their words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, str | None] = {}

    def judge(self, word: str) -> str | None:
        """None: clean. Else the original; the word itself where it can't be recovered."""
        if word in self.known:
            return self.known[word]
        out = self._judge(word)
        if len(self.known) < 300_000:
            self.known[word] = out
        return out

    def _judge(self, word: str) -> str | None:
        if "\ufffd" in word:
            return word
        m = self.model
        # an accented capital after a small letter is no clean word's way
        strange = _MIXED_CASE.search(word) is not None
        if _PLAIN.fullmatch(word) and not strange and m.clean_bigrams[_bigrams(word)].all():
            return None
        now = m.fit_of(word)
        # look-alike letters, other spaces and compatibility forms are no matter of encodings
        other = base_form(word)
        disguised = (other != word or any(ch in LOOK for ch in other)) and all(ch.isascii() or ch in LOOK or _PLAIN.fullmatch(ch) for ch in other)
        letters = other.strip(".,;:!?()\u00ab\u00bb\"'").replace("-", "").replace("'", "").isalpha() and any(ch in LOOK for ch in other) and any(ch.isascii() and ch.isalpha() for ch in other)
        for k in m.ranked(word):
            if k == 0:
                if now > -9.0 and not strange and len(word) > 1:
                    return None
                continue
            chain = CHAINS[k]
            if chain[0][0] == "utf-8":
                got = invert(word, chain)
                if got is None and (word in ("\u00c3", "\u251c") or word[-1:] in "\u00c3\u0413\u251c\u221a" and not word.isupper()):
                    # the second byte of a final letter was a space, and spaces get lost
                    got = invert(word + _wrong(b"\xa0", chain[-1][1]), chain)
                ok = got is not None and got != word and got.isprintable() and m.fit_of(got) - now > -2.0 and not (disguised and letters)
            else:
                got = None if disguised else invert(word, chain)
                ok = got is not None and got != word and all(ch.isascii() or _PLAIN.fullmatch(ch) for ch in got) and not _MIXED_CASE.search(got) and self._gain(word, got, now, strange)
            if ok:
                return got
        return None

    def _gain(self, word: str, got: str, now: float, strange: bool) -> bool:
        """Whether a word from a chain of single-byte encodings is surely better: foreign names read as strangely
        as garbled words do, so the result must be a word of the sample, or the word be no name at all."""
        m = self.model
        gain = m.fit_of(got) - now
        if _core(got) in m.vocabulary:
            return gain > (0.0 if strange or got in m.letters else 1.5)
        # a capital and then small letters with a few foreign ones among them: a name
        bare = _EDGES.sub("", word)
        name = bare[:1].isupper() and bare[1:].isalpha() and bare[1:].islower()
        return gain > (0.0 if strange or got in m.letters else 1.5) and not name

    def repair(self, text: str) -> tuple[str, bool]:
        """(text with the garbled words restored, whether any word is garbled)."""
        if text.isascii():
            return text, False
        found = False

        def word(m: re.Match) -> str:
            nonlocal found
            got = self.judge(m.group())
            if got is None:
                return m.group()
            found = True
            return got

        out = TOKEN.sub(word, text)
        return out, found

    def any(self, text: str) -> bool:
        return not text.isascii() and any(self.judge(w) is not None for w in set(TOKEN.findall(text)))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the words of at most `sample` documents, the first by hash of doc_id."""
    rows = first_by_hash(docs.select("doc_id", "text"), "doc_id", sample)
    words: set[str] = set()
    for r in rows:
        words.update(TOKEN.findall(r["text"] or ""))
    undo = [c for c in CHAINS if c and c[0][0] == "utf-8"]
    keep = [w for w in sorted(words) if _PLAIN.fullmatch(w) and not _MIXED_CASE.search(w) and not any((g := invert(w, c)) is not None and g != w for c in undo)]
    return Model(keep)


def garbled(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id): documents with at least one garbled place."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for pdf in pdfs:
            yield pdf.loc[[t is not None and d.any(t) for t in pdf["text"]], ["doc_id"]]

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long").distinct()


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, garbled): every document with its words restored where they can be."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for pdf in pdfs:
            got = [(None, False) if t is None else d.repair(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [g[0] for g in got], "garbled": [g[1] for g in got]})

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id long, text string, garbled boolean")
