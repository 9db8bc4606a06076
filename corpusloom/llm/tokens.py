"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from pathlib import Path

import tiktoken
from pyspark.sql import SparkSession

#: Vocabulary file of byte-level BPE ranks; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: How this family of vocabularies cuts text into pieces, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A vocabulary larger than this is refused, as it is sent to every task.
MAX_VOCABULARY_BYTES = 32 << 20


def load(spark: SparkSession, path: str = TOKENIZER):
    """Broadcast of the vocabulary file, whose size is checked first."""
    if Path(path).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def encoding(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts; a text is encoded in stretches that end where no piece goes on, so a long one needs no long buffer."""

    STRETCH = 1 << 20

    def __init__(self, data: bytes):
        self.encoding = encoding(data)

    def __call__(self, text: str) -> int:
        if len(text) <= self.STRETCH:
            return len(self.encoding.encode_ordinary(text))
        total = start = 0
        while start < len(text):
            end = min(len(text), start + self.STRETCH)
            # a piece never goes on from a visible character into a single space
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and not text[end + 1 : end + 2].isspace()):
                end += 1
            total += len(self.encoding.encode_ordinary(text[start:end]))
            start = end
        return total
