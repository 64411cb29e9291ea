"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the byte-level vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer, loaded once in a Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for an empty or null one."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def default_vocabulary(spark: SparkSession) -> str:
    """The vocabulary file: the session's ``spark.lectern.vocabulary``, or the public one on this machine."""
    return spark.conf.get("spark.lectern.vocabulary", VOCABULARY)


def sized(documents: DataFrame, key: str, vocabulary: str, *columns: str) -> DataFrame:
    """``key``, the named columns and ``tokens`` of every document with at least one token."""
    return documents.filter(F.length("text") > 0).select(key, *columns, token_count("text", vocabulary).alias("tokens")).filter("tokens > 0")
