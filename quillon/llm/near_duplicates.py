"""Documents that are versions of one text: similarity of their word shingles reaches a threshold.

Method: chosen-path join. In each of several runs a document follows the shared tokens (shingles) whose
hash falls below BRANCH / size of its set: level one splits all documents on such tokens, and a bucket
with more than LIMIT documents is split again on further tokens, level by level. The levels of BRANCH
are made in one pass over the texts; documents whose bucket is larger than BLOCK after them go on from
there in a further pass over these documents only, up to PASSES; from then on paths are chosen from a
consistent sample of SAMPLE tokens of each set (those of the least hash), so that no text is read or moved
again. The other buckets are compared by
brute force, and what remains after the last pass by brute force in blocks of BLOCK rows against each
other, so nothing is dropped and no task holds a whole bucket. Pairs whose 256-bit minhash sketches
agree far less than the threshold asks are left out (a margin of about 3.5 standard deviations); the
others are verified on the full sets. BRANCH is so wide that a pair at the threshold shares more than one
path on every level, and runs are repeated until such a pair is found with a probability of TARGET_RECALL
at the last level of the last pass; more similar pairs, and pairs that meet in a small bucket earlier,
are found more surely.

Documents with equal sets of shingles form a class; only one representative of each goes through the
join. The results are classes and links between representatives, and, where asked, all pairs.

Defined results: null texts, empty ones and those with less than `min_words` words take no part,
nor do rows without a doc_id; a text of fewer than k words is one shingle of all its words; rows stored twice count once, a doc_id with several texts is compared by
each of them (its highest similarity counts), never with itself; ties in a class go to the smallest
doc_id; an empty table gives empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut, release
from quillon.skew import join_cells, join_counted

TARGET_RECALL, BRANCH, PASSES, LIMIT, BLOCK = 0.98, (2.5, 2.5, 2.5), 3, 400, 2000
#: Texts whose sets are computed together.
AT_ONCE = 500
#: Keys are broadcast up to this number (8 MB), beyond it they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
SKETCH_BITS = 256
#: Tokens of a set that are kept for the further passes.
SAMPLE = 64

_WORDS = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(7)
_MULT = (_RNG.integers(1, 2**32, SKETCH_BITS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, SKETCH_BITS, dtype=np.uint64).astype(np.uint32)
_BIT = (_RNG.integers(0, 2**32, SKETCH_BITS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """The hash of a word, found out once a task."""

    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


#: Words whose hashes are remembered from one batch of texts to the next.
KNOWN_WORDS = 200_000
_HASHES = _Hashes()


@dataclass(frozen=True)
class Shape:
    """What is compared: k words a shingle, similarity from `threshold`, documents from `min_words`."""

    k: int = 5
    threshold: float = 0.8
    min_words: int = 1


def found_at(threshold: float, branch: tuple[float, ...] = BRANCH, passes: int = PASSES) -> float:
    """Probability that one run brings a pair at the threshold through all levels of all passes.

    Two sets of equal size share 2 t / (1 + t) of their tokens, so this part of the chosen ones; the shared
    paths are a branching process, whose survival is followed from the last level to the first.
    """
    found = 1.0
    for width in reversed(branch * passes):
        found = 1 - math.exp(-width * 2 * threshold / (1 + threshold) * found)
    return found


def runs_for(threshold: float, recall: float = TARGET_RECALL, branch: tuple[float, ...] = BRANCH, passes: int = PASSES) -> int:
    """Runs that find a pair at the threshold with this probability, however deep its buckets are split: 4 at 0.5, 3 at 0.8."""
    return math.ceil(math.log(1 - recall) / math.log(1 - found_at(threshold, branch, passes)))


def shingle_sets(texts: list[str | None], shape: Shape) -> list[np.ndarray | None]:
    """Sorted distinct 64-bit shingle hashes of each text; None for one that takes no part."""
    words = [_WORDS.findall(t.lower()) if t else [] for t in texts]
    total_words = sum(map(len, words))
    if not total_words:
        return [None] * len(texts)
    if len(_HASHES) > KNOWN_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.uint64, total_words)
    out: list[np.ndarray | None] = []
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(h) - shape.k + 1, 0), np.uint64)
        for i in range(shape.k):
            total = total * _U(0x9E3779B97F4A7C15) + h[i : len(h) - shape.k + 1 + i]
        total = _mix(total)
    at = 0
    for ws in words:
        n = len(ws)
        if n >= shape.k and n >= shape.min_words:
            out.append(np.unique(total[at : at + n - shape.k + 1]))
        elif n and n >= shape.min_words:
            out.append(np.array([xxhash.xxh3_64_intdigest(" ".join(ws), seed=n)], np.uint64))
        else:
            out.append(None)
        at += n
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """SKETCH_BITS one-bit minhashes as four 64-bit numbers."""
    low = tokens.astype(np.uint32)
    with np.errstate(over="ignore"):
        v = low[None, :] * _MULT[:, None]
        v += _ADD[:, None]
        v = v.min(1)
        bit = ((v * _BIT) >> np.uint32(16)) & np.uint32(1)
    return np.packbits(bit.astype(np.uint8)).view(">i8").astype(np.int64)


def short_tokens(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(32)).astype(np.uint32)


def sample(t: np.ndarray, size: int = SAMPLE) -> np.ndarray:
    """The tokens of the least hash: of two sets, shared tokens are sampled together."""
    if len(t) <= size:
        return t
    with np.errstate(over="ignore"):
        h = (t ^ (t >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
    return t[np.argpartition(h, size)[:size]]


def paths(t: np.ndarray, roots: np.ndarray, branch: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (place of the path above, token): the chosen paths below all roots; at level one the place is that of the root."""
    seed = (roots.astype(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(31)).astype(np.uint32)
    out = []
    for width in branch:
        below = np.uint32(min(int(width / len(t) * 2.0**32), 2**32 - 1))
        with np.errstate(over="ignore"):
            h = (t[None, :] ^ seed[:, None]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            # the same places as by np.nonzero in two dimensions, at less cost
            p, i = np.divmod(np.flatnonzero(h <= below), len(t))
            chosen = t[i]
            seed = (seed[p] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)) ^ (chosen * np.uint32(0x9E3779B1))
        out.append((p.astype(np.int16), chosen.view(np.int32)))
    return out


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _tree_fields(branch: tuple[float, ...]) -> str:
    return "roots array<long>, " + ", ".join(f"p{i} array<smallint>, t{i} array<int>" for i in range(1, len(branch) + 1))


def _tree_columns(tokens: list[np.ndarray], roots: list[np.ndarray], branch: tuple[float, ...]) -> list[pa.Array]:
    trees = [paths(t, r.view(np.uint64), branch) for t, r in zip(tokens, roots)]
    cols = [_lists(roots, pa.int64())]
    for level in range(len(branch)):
        cols += [_lists([x[level][0] for x in trees], pa.int16()), _lists([x[level][1] for x in trees], pa.int32())]
    return cols


def signed(docs: DataFrame, shape: Shape, runs: int, branch: tuple[float, ...] = BRANCH) -> DataFrame:
    """Each document's size of set, digest of set (d1, d2), sketch (s0 to s3), sample, and the chosen paths below each run (place pI, token tI).

    docs: (doc_id, text); the roots are the runs.
    """
    schema = "doc_id long, n int, d1 long, d2 long, s0 long, s1 long, s2 long, s3 long, sample array<int>, " + _tree_fields(branch)
    start = np.arange(1, runs + 1, dtype=np.int64)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sets = shingle_sets(batch.column(1).to_pylist(), shape)
        use = [k for k, x in enumerate(sets) if x is not None]
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[k].tobytes()) for k in use), ">i8").astype(np.int64).reshape(-1, 2)
        bits = np.array([sketch(sets[k]) for k in use], np.int64).reshape(-1, 4)
        tokens = [short_tokens(sets[k]) for k in use]
        cols = [pa.array(ids[use].astype(np.int64)), pa.array(np.array([len(sets[k]) for k in use], np.int32))]
        cols += [pa.array(np.ascontiguousarray(x[:, j])) for x in (digest, bits) for j in range(x.shape[1])]
        cols.append(_lists([sample(t).view(np.int32) for t in tokens], pa.int32()))
        cols += _tree_columns(tokens, [start] * len(use), branch)
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                yield rows(batch.slice(at, AT_ONCE))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def resumed(reps: DataFrame, branch: tuple[float, ...] = BRANCH) -> DataFrame:
    """The next pass's rows: paths below `roots`, the buckets that are to be split, from the sample of each set."""
    kept = ["doc_id", "n", "s0", "s1", "s2", "s3", "sample"]
    kinds = dict(reps.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", " + _tree_fields(branch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                tokens = [np.array(x, np.int32).view(np.uint32) for x in batch.column(len(kept) - 1).to_pylist()]
                roots = [np.array(x, np.int64) for x in batch.column(len(kept)).to_pylist()]
                cols = [*batch.columns[: len(kept)], *_tree_columns(tokens, roots, branch)]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return reps.select(*kept, "roots").mapInArrow(run, schema)


def _level(reps: DataFrame, i: int) -> DataFrame:
    """(doc_id, n, s0 ..., up, key): the paths of level i; a key is a hash of its run and tokens."""
    at = reps.select("*", F.explode(F.arrays_zip(F.col(f"p{i}").alias("p"), F.col(f"t{i}").alias("t"))).alias("x"))
    places = F.col("x.p")
    chain = [(F.col("x.p"), F.col("x.t"))]
    for j in range(i - 1, 0, -1):
        chain.append((F.get(f"p{j}", places), F.get(f"t{j}", places)))
        places = F.get(f"p{j}", places)
    keys = [F.get("roots", chain[-1][0])]
    for _, token in reversed(chain):
        keys.append(F.xxhash64(keys[-1], token))
    return at.select("doc_id", "n", "s0", "s1", "s2", "s3", keys[-2].alias("up"), keys[-1].alias("key"))


def _semi(rows: DataFrame, keys: DataFrame, n_keys: int, on: str) -> DataFrame:
    return rows.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, on, "left_semi")


def blocks(rows: DataFrame, key: str, size: str, number: str, limit: int) -> DataFrame:
    """Rows of groups larger than `limit`, for a brute-force join in blocks: cell (i, j) meets block i with block j.

    Adds `cell` (one number for group and pair of blocks), `own` (the row's block) and `same` (i = j).
    """
    nb = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    b = F.pmod(F.xxhash64(F.col(number)), nb).cast("int")
    r = rows.withColumn("_nb", nb).withColumn("own", b).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    i, j = F.least("own", "_o"), F.greatest("own", "_o")
    return r.withColumn("same", i == j).withColumn("cell", F.xxhash64(F.col(key), i, j)).drop("_nb", "_o")


def _pairs_in(groups: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """All pairs (x, y), x.doc_id < y.doc_id, of the rows of each group; groups are bounded by their maker."""
    g = groups.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("g")).where(F.size("g") > 1)
    first = g.select("g", F.posexplode("g").alias("at", "x")).where(F.col("at") < F.size("g") - 1)
    return first.select("x", F.explode(F.slice("g", F.col("at") + 2, F.size("g"))).alias("y"))


def _alike(threshold: float) -> F.Column:
    """Whether two sketches agree as far as pairs of this similarity do, with a margin of 3.5 standard deviations."""
    p = (1 + threshold) / 2
    most = int(SKETCH_BITS * (1 - p) + 3.5 * math.sqrt(SKETCH_BITS * p * (1 - p)))
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    small, large = F.least(F.col("x.n"), F.col("y.n")), F.greatest(F.col("x.n"), F.col("y.n"))
    return (differ <= most) & (small >= large * F.lit(threshold))


_ROW = ["doc_id", "n", "s0", "s1", "s2", "s3"]


def _near(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of pairs (x, y) whose sketches agree, stored; the shuffles behind them are given back."""
    kept = pairs.where((F.col("x.doc_id") < F.col("y.doc_id")) & _alike(threshold))
    out = cut(kept.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    release(pairs.sparkSession)
    return out


def _in_pass(reps: DataFrame, threshold: float, levels: int, limit: int, block: int, last: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """(a, b) pairs of the buckets of one pass, and (doc_id, key) of those that are to be split further."""
    found: list[DataFrame] = []
    big, n_big = None, 0
    for i in range(1, levels + 1):
        rows = _level(reps, i)
        if big is not None:
            rows = _semi(rows, big.select(F.col("key").alias("up")), n_big, "up")
        rows = rows.drop("up")
        most = limit if i < levels else block
        sizes = cut(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1))
        big = sizes.where(F.col("size") > most)
        n_big = big.count()
        # rows of large buckets stay out of the shuffle below, the largest buckets' rows in any case
        top = big if n_big <= BROADCAST_KEYS else big.orderBy(F.desc("size")).limit(BROADCAST_KEYS)
        kept = rows.join(F.broadcast(top.select("key")), "key", "left_anti") if n_big else rows
        small = kept.join(sizes.where(F.col("size") <= most).select("key"), "key", "left_semi")
        found.append(_near(_pairs_in(small, ["key"], _ROW), threshold))
        if not n_big:
            return found, None
        if i < levels:
            big = big.select("key")
    met = rows.join(F.broadcast(big) if n_big <= BROADCAST_KEYS else big, "key")
    if not last:
        return found, cut(met.select("doc_id", "key").distinct())
    cells = _pairs_in(blocks(met, "key", "size", "doc_id", block), ["cell", "same"], [*_ROW, "own", "same"])
    # in a cell of two blocks only rows of different blocks meet
    found.append(_near(cells.where(F.col("x.same") | (F.col("x.own") != F.col("y.own"))), threshold))
    return found, None


def candidates(reps: DataFrame, shape: Shape, branch: tuple[float, ...] = BRANCH, passes: int = PASSES, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of representatives that share a bucket and whose sketches agree; reps: the first pass's `signed` rows."""
    out: list[DataFrame] = []
    for k in range(passes):
        found, rest = _in_pass(reps, shape.threshold, len(branch), limit, block, last=k == passes - 1)
        out += found
        if rest is None:
            break
        # a document has few buckets in a pass (the product of BRANCH a root), so its list is short
        roots = rest.groupBy("doc_id").agg(F.collect_list("key").alias("roots"))
        reps = cut(resumed(reps.drop("roots").join(roots, "doc_id"), branch))
        release(reps.sparkSession)
    return reduce(DataFrame.unionByName, out).distinct()


def verified(docs: DataFrame, pairs: DataFrame, shape: Shape) -> DataFrame:
    """The pairs whose full sets reach the threshold, with their similarity."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), AT_ONCE):
                ids, texts = pdf["doc_id"].iloc[at : at + AT_ONCE], pdf["text"].iloc[at : at + AT_ONCE].tolist()
                got = [(d, t.view(np.int64)) for d, t in zip(ids, shingle_sets(texts, shape)) if t is not None]
                yield pd.DataFrame(got, columns=["doc_id", "set"])

    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(_semi(docs.select("doc_id", "text"), ids, ids.count(), "doc_id").mapInPandas(run, "doc_id long, set array<long>"))
    # a document may have very many partners: its set goes to each cell of them once
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    both = join_cells(join_cells(pairs, left, ["a"]), right, ["b"]).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    share = F.col("both") / (F.size("sa") + F.size("sb") - F.col("both"))
    near = both.select("a", "b", share.alias("similarity")).where(F.col("similarity") >= shape.threshold)
    return near.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


@dataclass(frozen=True)
class Versions:
    """members: (doc_id, rep, size), one row a document; links: (a, b, similarity) between representatives, a < b."""

    members: DataFrame
    links: DataFrame


def versions(docs: DataFrame, shape: Shape = Shape(), runs: int | None = None, branch: tuple[float, ...] = BRANCH, passes: int = PASSES, limit: int = LIMIT, block: int = BLOCK) -> Versions:
    """Classes of equal sets and the links between their representatives."""
    runs = runs or runs_for(shape.threshold, branch=branch, passes=passes)
    once = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    sig = cut(signed(once, shape, runs, branch))
    slim = sig.select("doc_id", "d1", "d2").distinct()
    classes = cut(slim.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where(F.col("size") > 1))
    # only classes of several documents are joined; all other documents represent themselves
    copies = cut(join_counted(slim, classes, ["d1", "d2"], "size").select("doc_id", "d1", "d2", "rep", "size"))
    others = copies.where(F.col("doc_id") != F.col("rep")).select("doc_id", "d1", "d2")
    n_others = others.count()
    own = ["doc_id", "d1", "d2"]
    if n_others <= BROADCAST_KEYS // 4:
        reps, members = sig.join(F.broadcast(others), own, "left_anti"), slim.join(F.broadcast(copies), own, "left")
    else:
        reps, members = cut(sig.join(others, own, "left_anti")), slim.join(copies, own, "left")
    members = members.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("size", F.lit(1)).alias("size"))
    pairs = cut(candidates(reps, shape, branch, passes, limit, block))
    return Versions(cut(members), cut(verified(once, pairs, shape)))


def all_pairs(v: Versions, limit: int = 1000) -> DataFrame:
    """(doc_id_a, doc_id_b): the links and classes spelled out for every document. The result grows with the square of a class."""
    m = v.members
    left, right = m.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), m.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
    # most representatives stand for themselves; the links of classes are spelled out cell by cell
    across = join_cells(cut(join_cells(v.links.select("a", "b"), left, ["a"])), right, ["b"]).select("x", "y")
    many = m.where(F.col("size") > 1)
    cells = blocks(many, "rep", "size", "doc_id", limit)
    inside = _pairs_in(cells, ["cell", "same"], ["doc_id", "own", "same"]).where(F.col("x.same") | (F.col("x.own") != F.col("y.own")))
    both = across.unionByName(inside.select(F.col("x.doc_id").alias("x"), F.col("y.doc_id").alias("y")))
    return both.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def groups(v: Versions) -> DataFrame:
    """(doc_id, group_id, n_links): one row a document; group_id is the smallest doc_id that links lead to.

    Labels are lowered along the links and then followed to their own label (pointer jumping), each
    round written to the shared folder, until none changes.
    """
    links = v.links.select("a", "b")
    edges = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("a").alias("label"), F.count("*").alias("n_links")))
    while True:
        # nodes of very many links are salted, and so are labels that very many nodes have come to
        near = join_counted(edges, labels.withColumnRenamed("node", "b"), ["b"], "n_links").groupBy("a").agg(F.min("label").alias("low"))
        low = cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"), "n_links"))
        used = cut(low.groupBy("label").agg(F.count("*").alias("_n")))
        up = cut(used.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label"))
        new = cut(join_counted(low, up, ["label"], "_n").select("node", "was", F.least("label", "further").alias("label"), "n_links"))
        labels = new.select("node", "label", "n_links")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            break
        release(edges.sparkSession)
    known = labels.select(F.col("node").alias("rep"), "label", "n_links")
    # only classes of several documents can be hot, and those are joined in cells
    many, one = v.members.where(F.col("size") > 1), v.members.where(F.col("size") == 1)
    linked = join_cells(many, known, ["rep"])
    alone = many.join(known.select("rep"), "rep", "left_anti").withColumns({"label": F.lit(None).cast("long"), "n_links": F.lit(None).cast("long")})
    out = one.join(known, "rep", "left").unionByName(linked).unionByName(alone)
    return out.select("doc_id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("size").alias("n_copies"))
