"""Whole texts to token ids, with the tokenizers library and a cache of chunks."""

from __future__ import annotations

import os
import re
import struct
from itertools import islice

from pyspark import SparkFiles
from pyspark.sql import SparkSession

# Unicode's White_Space, as the tokenizers' patterns mean by \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Python's split() also takes these for white space; the tokenizers don't.
_ODD = re.compile("[\x1c-\x1f]")
#: Chunks kept in a worker; beyond it the half met last goes, as frequent ones are met early.
CACHE_ENTRIES = 800_000
_LONGEST_KEPT = 64
_STOPS = frozenset(".,;:!?")
#: Byte-level vocabularies write a byte as its printable Latin-1 character, the others as those from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}


class _Cache(dict):
    """Ids of chunks, found when they are first asked for."""

    def __init__(self, tokenizer, keep_space: bool):
        super().__init__()
        self.tokenizer, self.model, self.keep_space = tokenizer, tokenizer.model, keep_space

    def _piece(self, text: str) -> bytes | None:
        """Ids of Latin letters, a space before them allowed: one piece, so the model's own step is enough."""
        letters = text[1:] if self.keep_space and text[:1] == " " else text
        if not letters.isalpha() or not (letters.isascii() or max(letters) < "\u0130"):
            return None
        if not self.keep_space:
            text = text.lower()
        found = self.model.tokenize(text.encode().decode("latin-1").translate(_BYTE_LEVEL))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def __missing__(self, chunk: str) -> bytes:
        # a Latin letter and a stop after it never share a piece
        if len(chunk) > 1 and chunk[-1] in _STOPS and chunk[-2] < "\u0130" and chunk[-2].isalpha():
            often = chunk[:-1] in self
            ids = self[chunk[:-1]] + self[chunk[-1]]
            if not often:  # its first sight: the word alone is kept
                return ids
        else:
            ids = self._piece(chunk)
            if ids is None:
                found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(chunk) <= _LONGEST_KEPT:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Encodes texts as the tokenizer does, looking up white-space delimited chunks.

    No piece of either vocabulary's pre-tokenizer spans from a non-space to a
    space, so a text's ids are its chunks' ids in a row. A chunk is a run of
    other characters, with the white space before it (``keep_space``: byte-level
    vocabularies) or without it. The library encodes each distinct chunk once.
    """

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keep_space = keep_space
        self.cache = _Cache(self.tokenizer, keep_space)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text (null: none)."""
        if not text:
            return b""
        if len(self.cache) > CACHE_ENTRIES:
            for chunk in list(islice(reversed(self.cache), CACHE_ENTRIES // 2)):
                del self.cache[chunk]
        if self.keep_space:
            chunks = _CHUNKS.findall(text)
        elif _ODD.search(text):
            return struct.pack(f"<{len(ids := self.tokenizer.encode(text, add_special_tokens=False).ids)}I", *ids)
        else:
            chunks = text.split()
        return b"".join(map(self.cache.__getitem__, chunks))


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to the workers' machines; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoder(name: str, keep_space: bool) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file that has been sent."""
    key = (name, keep_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(SparkFiles.get(name), keep_space)
    return _ENCODERS[key]


def forget() -> None:
    """Drop this worker's encoders and their caches; tasks of stages that encode nothing begin with it.

    Workers outlive stages, so what packing has cached would else lie beside a later stage's arrays.
    """
    _ENCODERS.clear()


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; any other path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
