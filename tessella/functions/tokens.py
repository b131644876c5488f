"""Tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed value: how the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = os.environ.get("TESSELLA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str = DEFAULT):
    """The tokenizer of a ``.tiktoken`` file of ranks; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_sizes(df: DataFrame, text: str, keep: list[str], tokenizer: str = DEFAULT) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row's text; the text itself goes no further. Null counts as empty."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"

    def run(batches):
        encode = encoding(tokenizer).encode_ordinary
        for pdf in batches:
            sizes = [len(encode(t)) if t else 0 for t in pdf["_text"]]
            yield pd.concat([pdf[keep], pd.Series(sizes, index=pdf.index, name="n_tokens", dtype="int64")], axis=1)

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def with_tokens(df: DataFrame, text: str, keep: list[str], tokenizer: str = DEFAULT) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the ids of each row's text. Null counts as empty."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens array<int>"

    def run(batches):
        encode = encoding(tokenizer).encode_ordinary
        for pdf in batches:
            yield pdf[keep].assign(tokens=[encode(t) if t else [] for t in pdf["_text"]])

    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def decode(tokens: list[int], tokenizer: str = DEFAULT) -> str:
    return encoding(tokenizer).decode(tokens)
