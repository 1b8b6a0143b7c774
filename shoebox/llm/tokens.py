"""Sizes in tokens of a public tokenizer, whose vocabulary file stays where it is."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file, unless a caller or SHOEBOX_VOCABULARY names another: one of the driver's, which ships it.
RANKS = os.environ.get("SHOEBOX_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that cuts text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ship(spark: SparkSession, path: str = RANKS) -> None:
    """Make the driver's vocabulary file one of the session's, which every executor fetches before its tasks."""
    name = os.path.basename(path)
    if os.path.exists(path) and not any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str = RANKS) -> tiktoken.Encoding:
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str = RANKS) -> np.ndarray:
    """The length in bytes of each token."""
    code = encoder(path)
    return np.array([len(code.decode_single_token_bytes(i)) for i in range(code.n_vocab)], "int64")


def token_codes(text: Column, path: str = RANKS) -> Column:
    """The tokens of a text, two bytes each; NULL for NULL."""

    @F.pandas_udf("binary")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = encoder(path)
        if of.n_vocab > 2**16:
            raise ValueError("the vocabulary has more tokens than two bytes tell apart")
        for series in texts:
            yield pd.Series([None if t is None else np.array(of.encode_ordinary(t), CODES).tobytes() for t in series], dtype=object)

    return code(text)


#: Two bytes hold the tokens of a vocabulary of up to 65,536.
CODES = "uint16"


def codes_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, CODES)


def token_count(text: Column, path: str = RANKS) -> Column:
    """How many tokens a text has; 0 for NULL. Where executors lack the file, ``ship`` it first."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = encoder(path)
        for series in texts:
            yield pd.Series([0 if t is None else len(code.encode_ordinary(t)) for t in series], dtype="int64")

    return count(text)
