"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file."""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of a public byte-level vocabulary on this machine, and the pattern its texts are first cut by."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, keep: list[str], text: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The columns `keep` and n_tokens (long) of every row with a text; an empty text has 0, a null text has no row.

    vocabulary: path of a vocabulary file that every executor can read, and its pattern. Whole texts are encoded; strings of
    special tokens are ordinary text.
    """
    path, pattern = vocabulary or public_vocabulary()
    chosen = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    schema = chosen.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def sizes(batches):
        encode = _encoding(path, pattern).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            # lone surrogates can't occur in Arrow strings, so every text can be encoded
            n = pa.array([len(encode(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return chosen.mapInArrow(sizes, schema)
