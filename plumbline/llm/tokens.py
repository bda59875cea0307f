"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabulary file (ranks of a byte-level BPE, base64 token and rank per line); a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this family splits text before merging (fixed value of the format).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary file; loaded once per Python worker."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for an empty text and for NULL.

    ``vocabulary`` is a path that executors have, or the name of a file added to the session.
    """

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary if os.path.isabs(vocabulary) else SparkFiles.get(vocabulary))
        for texts in parts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts.tolist()], dtype="int32")

    return count(text)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` reduced to doc_id, source and ``tokens``; the vocabulary file goes from the driver to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    return documents.select("doc_id", "source", token_count("text", os.path.basename(vocabulary)).alias("tokens"))
