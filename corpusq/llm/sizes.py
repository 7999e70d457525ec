"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A rank file of a byte-level tokenizer; the same place on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of such files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer in `path`, read once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_sizes(df: DataFrame, text: str = "text", path: str = TOKENIZER, column: str = "n_tokens") -> DataFrame:
    """`df` with the number of tokens instead of the text; NULL and empty texts have 0. One pass, no shuffle."""
    keep = [f for f in df.schema.fields if f.name != text]
    if column in {f.name for f in keep}:
        raise ValueError(f"column name in use: {column}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in batches:
            n = pa.array([len(e.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], n], names=[*[f.name for f in keep], column])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(column, T.LongType())]))
