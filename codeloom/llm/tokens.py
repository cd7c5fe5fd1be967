"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A vocabulary of byte-level ranks; it must be readable at this path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """df without its text, with the number of its tokens; 0 for null and empty text. Special tokens' strings are ordinary text."""
    keep = [c for c in df.columns if c != text_col]
    schema = df.select(*keep).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = [len(e.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(n, pa.int64())], names=[*keep, out])

    return df.mapInArrow(run, schema)
