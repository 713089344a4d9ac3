"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os.path

import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, loaded once per process. Nothing is trained.

    A worker reads the copy that was shipped to it, if there is one.
    """
    if vocabulary not in _loaded:
        shipped = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
        with open(shipped if os.path.exists(shipped) else vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[vocabulary] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary]


def with_sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` (with a ``text`` column) with ``text`` replaced by ``n_tokens``; null texts have 0."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    names = [c for c in docs.columns if c != "text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return docs.select(*names, "text").mapInArrow(run, ", ".join([*fields, "n_tokens long"]))


def family(col: str = "source"):
    """A source's family: case and outer blanks do not matter; null is ``(none)``."""
    clean = F.lower(F.trim(F.col(col)))
    return F.when(clean.isNull() | (clean == ""), "(none)").otherwise(clean)
