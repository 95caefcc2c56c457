"""Sizes in tokens of a public tokenizer; its vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that this vocabulary is made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The encoding of a vocabulary file; kept for the life of a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, extra: list[str] = (), path: str = VOCABULARY) -> DataFrame:
    """(doc_id, extra ..., n_tokens); a null or empty text has 0 tokens, rows without a doc_id are left out."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            e = encoder(path)
            pdf["n_tokens"] = [len(e.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pdf.drop(columns="text")

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", *extra]) + ", n_tokens long"
    return docs.select("doc_id", *extra, F.col("text")).where(F.col("doc_id").isNotNull()).mapInPandas(run, schema)
