"""Lines that one source repeats from document to document.

Method: content-defined chunking of the whole text, line feeds included. A rolling (gear) hash over the last
WINDOW bytes cuts the text where its high bits are zero, whatever stands there; each chunk is counted over
the distinct documents of its source, and what is made of chunks that repeat excessively is cut. A cut
further than WINDOW bytes into a line depends on the line alone, so the chunks between such cuts are the
same wherever the line stands; a line too short to hold one is a chunk itself. Results are stated in
lines: a line can only stand in `min_docs` documents if all its chunks do; lines that pass are counted
once more by a 128-bit digest of the whole line (exact check). `cut_spans` states them in characters, for texts without
line feeds.

Defined results: a null text has no lines, a null source_id is no source (its lines are never found),
rows without a doc_id have no lines, blank lines are never found, repeated rows of one doc_id count as one document
(of several texts under one doc_id, each line counts under its number), an empty table gives
an empty result. Only doc_id, source_id and text are read; other columns pass through `remove_lines` and `cut_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import cut
from quillon.skew import join_counted

WINDOW = 8
#: Bits of the rolling hash that must be zero at a cut: chunks of 2**6 bytes on average.
CUT_BITS = 6
#: Bytes of text whose hashes are computed together.
AT_ONCE = 1 << 20

_RNG = np.random.default_rng(20240229)
_GEAR = _RNG.integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_GEAR[0] = 0  # the filler between lines leaves no trace in the hash
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def fold_line(line: str) -> str:
    """The form in which lines are compared: case and white space do not count."""
    return " ".join(line.split()).lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def chunk_texts(texts: list[bytes], at_once: int = AT_ONCE) -> tuple[np.ndarray, ...]:
    """The content-defined chunks of each text: (index of text, begin, end, 64-bit hash of chunk, whether its content ends it, not the text's end), in order.

    Texts are taken together up to `at_once` bytes, so the arrays stay small whatever a batch holds.
    """
    out, first = [], 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= at_once):
            size += len(texts[last]) + WINDOW
            last += 1
        no, *rest = _chunks(texts[first:last])
        out.append((no + first, *rest))
        first = last
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    pad = b"\x00" * WINDOW
    buf = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + WINDOW) - size
    end = start + size
    g = _GEAR[buf]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint32(k)
    at = (h >> np.uint32(WINDOW - 1)) & np.uint32((1 << CUT_BITS) - 1) == 0
    at &= buf != 0
    natural = at.copy()
    at[end - 1] |= size > 0  # a text's end closes its last chunk
    stop = np.flatnonzero(at) + 1
    no = np.searchsorted(start, stop - 1, side="right") - 1
    begin = np.empty_like(stop)
    begin[1:] = stop[:-1]
    first = np.r_[True, no[1:] != no[:-1]] if len(no) else np.empty(0, bool)
    begin[first] = start[no[first]]
    return no, begin - start[no], stop - start[no], _hashes(buf, begin, stop), natural[stop - 1]


def _hashes(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of a buffer."""
    n = len(buf)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, _P, np.uint64))
        inverse = np.cumprod(np.full(n + 1, _P_INV, np.uint64))
        total = np.r_[np.uint64(0), np.cumsum(_BYTE[buf] * power[:n])]
        return _mix((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))


class _Batch:
    """The texts of a batch as folded lines, and their chunks.

    owner: row of each non-blank line; number: its line number; line: folded bytes. For each chunk the row, and
    the line that holds it (-1 for one that reaches over a line's end, or depends on what stands before the line).
    """

    def __init__(self, pdf: pd.DataFrame):
        self.owner, self.number, self.line, texts, spans = [], [], [], [], []
        salts: dict[str, int] = {}
        salt = []
        for i, (source, text) in enumerate(zip(pdf["source_id"], pdf["text"])):
            lines, at = [], 0
            for k, raw in enumerate(text.split("\n")):
                folded = fold_line(raw)
                if folded:
                    b = folded.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x01")
                    self.owner.append(i)
                    self.number.append(k + 1)
                    self.line.append(b)
                    spans.append((at, at + len(b)))
                    lines.append(b)
                    at += len(b) + 1
            texts.append(b"\n".join(lines))
            salt.append(salts.get(source) or salts.setdefault(source, xxhash.xxh3_64_intdigest(source)))
        self.salt = np.array(salt, np.uint64)
        no, begin, end, chunk, natural = chunk_texts(texts)
        n_lines = len(self.line)
        of = np.array(self.owner, np.int64)
        span = np.array(spans, np.int64).reshape(-1, 2)
        # texts one after another, so that lines and chunks are in one order
        shift = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1] if texts else np.empty(0, np.int64)
        first, last = span[:, 0] + shift[of], span[:, 1] + shift[of]
        b, e = begin + shift[no], end + shift[no]
        line = np.searchsorted(first, b, side="right") - 1
        ok = (line >= 0) & (b >= first[line] + WINDOW) & (e <= last[line]) if n_lines else np.zeros(len(no), bool)
        inner = np.where(ok & natural, line, -1)
        short = np.setdiff1d(np.arange(n_lines), inner)
        own = np.array([xxhash.xxh3_64_intdigest(self.line[k]) for k in short], np.uint64)
        # chunks of the texts, then the lines that are chunks themselves
        self.row = np.r_[no, of[short]].astype(np.int64)
        self.holds = np.r_[inner, short].astype(np.int64)
        self.begin, self.end = np.r_[begin, span[short, 0]], np.r_[end, span[short, 1]]
        self.of_text = np.r_[np.ones(len(no), bool), np.zeros(len(short), bool)]
        hashes = np.r_[chunk, own]
        self.key = _mix(hashes ^ self.salt[self.row]).view(np.int64) if len(hashes) else np.empty(0, np.int64)


def _seen(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct (key, doc_id) of a batch."""
    for pdf in pdfs:
        x = _Batch(pdf)
        yield pd.DataFrame({"key": x.key, "doc_id": pdf["doc_id"].to_numpy()[x.row]}).drop_duplicates()


def _placed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of each line; the first of them carries the digest of the whole line."""
    for pdf in pdfs:
        x = _Batch(pdf)
        use = np.flatnonzero(x.holds >= 0)
        use = use[np.argsort(x.holds[use], kind="stable")]
        line = x.holds[use]
        size = np.bincount(line, minlength=len(x.line))
        first = np.r_[True, line[1:] != line[:-1]] if len(line) else np.empty(0, bool)
        digest = [xxhash.xxh3_128_digest(b + int(x.salt[o]).to_bytes(8, "big")) for b, o in zip(x.line, x.owner)]
        d = np.frombuffer(b"".join(digest), ">i8").reshape(-1, 2).astype(np.int64)
        out = pd.DataFrame({"key": x.key[use], "doc_id": pdf["doc_id"].to_numpy()[x.row[use]], "line_no": np.array(x.number, np.int32)[line], "n_chunks": size[line].astype(np.int32)})
        # lines of several texts under one doc_id and number are told apart by their digest
        out["h1"], out["h2"] = pd.array(d[line, 0], "Int64"), d[line, 1]
        out.loc[~first, "h1"] = pd.NA
        yield out


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source_id", "text").where(F.col("doc_id").isNotNull() & F.col("source_id").isNotNull() & F.col("text").isNotNull())


def repeated_chunks(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """(key, n): chunks, within their source, that stand in n different documents, at least `min_docs`."""
    each = _identified(docs).mapInPandas(_seen, "key long, doc_id long").distinct()
    return each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)


def repeated_lines(docs: DataFrame, min_docs: int = 5) -> DataFrame:
    """(doc_id, line_no): the lines that stand in at least `min_docs` different documents of their source."""
    hot = cut(repeated_chunks(docs, min_docs))
    chunks = _identified(docs).mapInPandas(_placed, "key long, doc_id long, line_no int, n_chunks int, h1 long, h2 long")
    lines = (
        join_counted(chunks, hot, ["key"], "n")
        .groupBy("doc_id", "line_no", "h2")
        .agg(F.max("n_chunks").alias("n_chunks"), F.count("*").alias("found"), F.max("h1").alias("h1"))
        .where((F.col("found") >= F.col("n_chunks")) & F.col("h1").isNotNull())
        .select("doc_id", "line_no", "h1", "h2")
    )
    lines = cut(lines)
    often = cut(lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))
    return join_counted(lines, often, ["h1", "h2"], "n").select("doc_id", "line_no").distinct()


#: Least length, in bytes, of a run of repeated chunks that is cut from a text.
SPAN = 120


def _fold_places(text: str) -> tuple[bytes, list[int]]:
    """The text as it is chunked, and for each of its bytes the place in the text it comes from."""
    out, places, at = [], [], 0
    for raw in text.split("\n"):
        line = [(ch, at + k) for k, word in _words(raw) for ch, k in [(" ", k - 1), *((c, k + j) for j, c in enumerate(word))]][1:]
        if line:
            if out:
                out.append("\n")
                places.append(at - 1)
            for ch, k in line:
                low = ch.lower()
                out.append(low)
                places += [k] * len(low.encode("utf-8", "surrogatepass"))
        at += len(raw) + 1
    return "".join(out).encode("utf-8", "surrogatepass").replace(b"\x00", b"\x01"), places


def _words(line: str) -> Iterator[tuple[int, str]]:
    at = 0
    for word in line.split():
        at = line.index(word, at)
        yield at, word
        at += len(word)


def cut_spans(docs: DataFrame, min_docs: int = 5, span: int = SPAN) -> DataFrame:
    """`docs` with text freed of runs of at least `span` bytes of chunks that stand in `min_docs` documents of the source or more,
    and n_cut, the number of runs. For texts whose lines are no units; all rows and columns stay."""
    hot = cut(repeated_chunks(docs, min_docs))

    def placed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            x = _Batch(pdf)
            t = x.of_text
            yield pd.DataFrame({"key": x.key[t], "doc_id": pdf["doc_id"].to_numpy()[x.row[t]], "begin": x.begin[t], "end": x.end[t]})

    found = join_counted(_identified(docs).mapInPandas(placed, "key long, doc_id long, begin int, end int"), hot, ["key"], "n")
    runs = found.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("_runs"))

    def freed(text: str | None, runs) -> tuple[str | None, int]:
        if not text or runs is None:
            return text, 0
        joined: list[list[int]] = []
        for r in runs:
            if joined and r["begin"] <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], r["end"])
            else:
                joined.append([r["begin"], r["end"]])
        long = [(b, e) for b, e in joined if e - b >= span]
        if not long:
            return text, 0
        _, places = _fold_places(text)
        out, at = [], 0
        for b, e in long:
            out.append(text[at : places[b]])
            at = places[e] if e < len(places) else len(text)
        return "".join(out) + text[at:], len(long)

    names = docs.columns

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            got = [freed(t, r) for t, r in zip(pdf["text"], pdf["_runs"])]
            pdf["text"], pdf["n_cut"] = [g[0] for g in got], [g[1] for g in got]
            yield pdf[[*names, "n_cut"]]

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_cut int"
    return docs.join(runs, F.col("doc_id") == F.col("_doc"), "left").drop("_doc").mapInPandas(run, schema)


def without_lines(text: Column, numbers: Column) -> Column:
    """The text without the lines of these numbers."""
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.coalesce(F.array_contains(numbers, (i + 1).cast("int")), F.lit(False)))
    return F.array_join(kept, "\n")


def remove_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """`docs`, all rows and columns, with text freed of `lines` and n_removed, their number."""
    drop = lines.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_drop"))
    out = docs.join(drop, F.col("doc_id") == F.col("_doc"), "left")
    # a null text stays null; a document that loses every line keeps an empty text
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("_drop")))
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*cols, F.coalesce(F.size("_drop"), F.lit(0)).alias("n_removed"))
