"""Encoding whole texts with a public byte-level BPE tokenizer, and decoding them again.

The rank file is read once on the driver (a fixed vocabulary, below 1 MB) and broadcast, so
executors need no copy of it; each Python worker builds its encoder once. Long texts are cut
where the pre-splitting pattern always ends a piece, so pieces, ids and memory stay those of the
whole text while one call never sees an unbounded string of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
# Fixed value: the pre-splitting pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts longer than this many characters are pre-split. A parameter of speed, never of the result.
LONG = 50_000
# After a non-blank before a blank, or between a letter and a digit, every piece ends: no
# alternative of the pattern reaches over these places, and none looks back.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def ranks_of(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in blob.splitlines() if line)}


@lru_cache(maxsize=4)
def _encoder(blob: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("fichier", pat_str=pattern, mergeable_ranks=ranks_of(blob), special_tokens={})


def cut_safely(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of about ``size`` characters whose pieces are those of the whole text; an unbroken run stays whole."""
    begin = 0
    while len(text) - begin > size:
        m = _SAFE.search(text, begin + size)
        if m is None:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


class Tokenizer:
    """A byte-level BPE of the folder of public tokenizers; ``folder`` and ``name`` are parameters."""

    def __init__(self, spark: SparkSession, name: str = DEFAULT, folder: str = FOLDER, pattern: str = PATTERN, long: int = LONG):
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            self.blob = spark.sparkContext.broadcast(f.read())
        self.pattern, self.long = pattern, long

    def _udf(self, each, kind: str):
        blob, pattern = self.blob, self.pattern

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _encoder(blob.value, pattern)
            for s in batches:
                yield s.map(lambda v: each(encoder, v))

        return run

    def ids(self, text: Column) -> Column:
        """``array<int>`` without special tokens; null and empty texts give an empty array."""
        long = self.long

        def each(encoder, v):
            if not v:
                return []
            if len(v) <= long:
                return encoder.encode_ordinary(v)
            return [i for part in cut_safely(v, long) for i in encoder.encode_ordinary(part)]

        return self._udf(each, "array<int>")(text)

    def count(self, text: Column) -> Column:
        """Number of tokens (long); 0 for null and empty texts. The ids never leave the worker."""
        long = self.long

        def each(encoder, v):
            return sum(len(encoder.encode_ordinary(part)) for part in cut_safely(v, long)) if v else 0

        return self._udf(each, "bigint")(text)

    def decode(self, ids: Column) -> Column:
        """The UTF-8 bytes of the ids (binary); ids of any prefix decode, split characters included."""
        return self._udf(lambda encoder, v: encoder.decode_bytes(list(v)) if v is not None else b"", "binary")(ids)


def encode(df: DataFrame, text: str, keys: list[str], name: str = DEFAULT, folder: str = FOLDER) -> DataFrame:
    """``keys, ids``. Reads only keys and text, in one narrow stage; ties, repeats and extra columns don't matter."""
    return df.select(*keys, Tokenizer(df.sparkSession, name, folder).ids(F.col(text)).alias("ids"))
