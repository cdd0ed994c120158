"""Token counts by byte-pair merging with a heap and a linked list.

The count of a piece is its number of bytes minus the number of merges; tokens get no
identifiers. The ranks come from a public tokenizer file whose path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published splitting pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 300_000
CACHED_CHARS = 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    name: str  # digest of the file
    ranks: dict[tuple[bytes, bytes], int]
    specials: list[str]


def load_vocabulary(path: str) -> Vocabulary:
    """Merge ranks and special strings of a byte-level tokenizer file (JSON)."""
    with open(path, "rb") as file:
        raw = file.read()
    content = json.loads(raw)
    before = content["pre_tokenizer"] or {}
    if content["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without prefix space are counted")
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    if content.get("normalizer") or any(t[f] for t in content["added_tokens"] for f in flags):
        raise ValueError("normalizers and special strings with options are not supported")
    letters = byte_letters()
    plain = lambda s: bytes(letters[c] for c in s)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"])
    ranks = {(plain(a), plain(b)): rank for rank, (a, b) in enumerate(pairs)}
    return Vocabulary(hashlib.sha256(raw).hexdigest(), ranks, [t["content"] for t in content["added_tokens"]])


def piece_tokens(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Tokens of one piece: the lowest-ranked adjacent pair, leftmost first, is merged until none has a rank."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i]
        # an entry is stale when either side was merged since: then the sizes no longer add up
        if not part[i] or j >= n or len(part[i]) + len(part[j]) != size or ranks.get((part[i], part[j])) != rank:
            continue
        part[i] += part[j]
        part[j] = b""
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((part[i], part[k]))) is not None:
                heapq.heappush(heap, (rank, i, len(part[i]) + len(part[k])))
        h = before[i]
        if h >= 0 and (rank := ranks.get((part[h], part[i]))) is not None:
            heapq.heappush(heap, (rank, h, len(part[h]) + len(part[i])))
    return n - merges


class Counting:
    """Counts tokens of texts; keeps the counts of short pieces up to a fixed number."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.pieces = regex.compile(PIECES).findall
        specials = sorted(vocabulary.specials, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.known: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = piece_tokens(piece.encode(), self.ranks)
            if len(piece) <= CACHED_CHARS:
                if len(self.known) >= CACHED_PIECES:
                    self.known.clear()
                self.known[piece] = count
        return count

    def count(self, text: str) -> int:
        parts, total = [text], 0
        if self.specials is not None:
            parts = self.specials.split(text)
            total = len(parts) - 1
        for part in parts:
            for piece, times in Counter(self.pieces(part)).items():
                total += times * self._piece(piece)
        return total


_COUNTING: dict[str, Counting] = {}


def counting(vocabulary: Vocabulary) -> Counting:
    """One counter a worker and vocabulary, so that piece counts are kept from task to task."""
    if vocabulary.name not in _COUNTING:
        _COUNTING[vocabulary.name] = Counting(vocabulary)
    return _COUNTING[vocabulary.name]


def token_count(text: Column, vocabulary: Vocabulary, spark) -> Column:
    """Tokens of each whole text; a null text counts as empty and has none.

    The vocabulary is broadcast; its size is that of the file, not of the data. A special
    string inside a text is one token. Workers keep piece counts from task to task.
    """
    held = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counting(held.value).count
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return counts(text)
