"""Token ids of whole texts by a public byte-level BPE, one task at a time.

The ranks file holds the same vocabulary as the tokenizers JSON of that name; the tests
hold the ids of both against each other. The file's bytes (under 1 MB) are broadcast, so
executors need no copy of it. With the tokenizers JSON, its added tokens within a text get
their own ids, as that library gives them; without it they are spelt out as ordinary text."""

from __future__ import annotations

import base64
import json
from array import array
from pathlib import Path

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

END_OF_TEXT = 50256
#: Longest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizers JSON and their ids."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"an added token of {path} is not matched to the letter")
    return tuple((t["content"], t["id"]) for t in found)


def vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None, tokenizer: str | None = None) -> Broadcast:
    """tokenizer: the tokenizers JSON whose added tokens count as such within texts."""
    ranks = Path(path or default_vocabulary()).read_bytes()
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {len(ranks)} bytes is not meant for broadcast")
    return spark.sparkContext.broadcast((ranks, pattern or default_pattern(), added_tokens(tokenizer) if tokenizer else ()))


def _encoding(ranks: bytes, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("broadcast", pat_str=pattern, mergeable_ranks=merges, special_tokens=dict(added))


class Encoder:
    """Made once in each task. The worker keeps what it has built beside the broadcast, for
    its later tasks; a cached function would need this package on the executors."""

    def __init__(self, vocabulary: Broadcast):
        encoding = getattr(vocabulary, "encoding", None)
        if encoding is None:
            encoding = vocabulary.encoding = _encoding(*vocabulary.value)
        self._core, self._added = encoding._core_bpe, encoding.special_tokens_set
        #: Which ids begin with a space.
        self.spaced = getattr(vocabulary, "spaced", None)
        if self.spaced is None:
            self.spaced = vocabulary.spaced = np.zeros(1 << 16, bool)
            self.spaced[[rank for token, rank in encoding._mergeable_ranks.items() if token[:1] == b" "]] = True

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of the whole text; a null text has none."""
        return np.frombuffer(array("I", self._encode(text or "")), np.uint32)

    def _encode(self, text: str) -> list[int]:
        return self._core.encode(text, self._added) if self._added else self._core.encode_ordinary(text)
