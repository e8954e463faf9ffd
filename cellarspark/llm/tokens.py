"""Token counts by a public vocabulary; its file's place is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: byte-level vocabulary for many languages
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# ---- fixed value: the vocabulary's splitting pattern ----
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ---- end of fixed value ----


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The encoding of a vocabulary file, once per process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, keys: list[str], text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys, tokens): the tokens of each whole text; NULL and '' have none."""
    types = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*keys, "tokens"])

    fields = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return docs.select(*keys, F.col(text_col).alias("__text")).mapInArrow(count, f"{fields}, tokens long")
