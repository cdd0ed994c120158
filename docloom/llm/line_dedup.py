"""Removal of lines that many documents share, by arrays behind minimal perfect hashes.

Line hashes found in enough documents are dealt to shards. Each shard holds a minimal
perfect hash over its hashes (levels of bit arrays; a key sits at the first level where it
is alone) that numbers them 0 to n - 1, and two arrays under that number: fingerprints,
which reject lines that are not in the shard, and document counts. Documents probe the
arrays where they are read; lines are never joined and texts never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import with_checkpoints

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"
LOAD = 1.5
MAX_LEVELS = 64
NO_KEY = 0
INDEX_SCHEMA = "shard int, levels binary, sizes array<long>, fingerprints binary, counts binary"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(lines: Column, min_chars: int) -> Column:
    """A hash for each line's key; NO_KEY where the key has fewer than min_chars code points."""

    def of_line(line: Column) -> Column:
        key = F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())
        return F.when(F.length(key) >= max(1, min_chars), F.xxhash64(key)).otherwise(F.lit(NO_KEY).cast("bigint"))

    return F.transform(lines, of_line)


def shared_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """line_hash, n_docs: the lines found in at least min_docs documents (rows of docs)."""
    hashes = F.array_distinct(line_hashes(lines_of(F.col("text")), min_chars))
    return (
        docs.select(F.explode(hashes).alias("line_hash"))
        .filter(F.col("line_hash") != NO_KEY)
        .groupBy("line_hash")
        .agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs)
    )


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser with another seed for each level."""
    x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bits of all levels and the size of each, for distinct uint64 keys."""
    bits, sizes, left = [], [], keys
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        size = max(8, int(LOAD * len(left)))
        place = (_mix(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = left[~alone[place]]
    if len(left):
        raise ValueError("keys must be distinct")
    return (np.concatenate(bits) if bits else np.zeros(0, bool)), sizes


class Shard:
    """One shard, ready to be probed."""

    def __init__(self, row):
        self.sizes = list(row["sizes"])
        self.bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4")

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 or that of another key for one not in the shard."""
        found = np.full(len(keys), -1, np.int64)
        start, open_keys = 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_keys):
                break
            place = start + (_mix(keys[open_keys], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            found[open_keys[hit]] = self.rank[place[hit]] - 1
            open_keys = open_keys[~hit]
            start += size
        return found

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """How many documents hold each key's line; 0 for one not in the shard."""
        number = self.numbers(keys)
        known = number >= 0
        known[known] = self.fingerprints[number[known]] == keys[known]
        out = np.zeros(len(keys), np.int64)
        out[known] = self.counts[number[known]]
        return out


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(keys, MAX_LEVELS) % np.uint64(shards)).astype(np.int64)


def build_index(shared: DataFrame, shards: int) -> DataFrame:
    """One row of INDEX_SCHEMA for each shard that has lines."""

    def shard_numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(shard=_shard_of(batch["line_hash"].to_numpy("int64").view("u8"), shards))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["line_hash"].to_numpy("int64").view("u8")
        bits, sizes = build_hash(keys)
        row = {"shard": int(rows["shard"].iloc[0]), "levels": np.packbits(bits).tobytes(), "sizes": sizes}
        order = np.argsort(Shard({**row, "fingerprints": b"", "counts": b""}).numbers(keys))
        counts = np.minimum(rows["n_docs"].to_numpy("int64"), 2**32 - 1)[order].astype("<u4")
        row |= {"fingerprints": keys[order].astype("<u8").tobytes(), "counts": counts.tobytes()}
        return pd.DataFrame([row])

    numbered = shared.mapInPandas(shard_numbers, "line_hash long, n_docs long, shard int")
    return numbered.groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


def _over_limit(hashes: Column, shard_rows, shards: int, min_docs: int, spark) -> Column:
    """For each line, whether the shards given count it in min_docs documents or more."""
    held = spark.sparkContext.broadcast(shard_rows)

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = {row["shard"]: Shard(row) for row in held.value}
        for batch in batches:
            ends = np.cumsum([len(x) for x in batch])
            keys = np.concatenate([*batch, np.zeros(0, np.int64)]).astype(np.int64).view("u8")
            drop = np.zeros(len(keys), bool)
            shard = _shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for number, part in index.items():
                mine = order[cuts[number] : cuts[number + 1]]
                drop[mine] = (part.counts_of(keys[mine]) >= min_docs) & (keys[mine] != NO_KEY)
            yield pd.Series(np.split(drop, ends[:-1]) if len(ends) else [], dtype=object)

    return probe(hashes)


def drop_shared_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_lines: int = 1 << 16, shards_at_once: int = 64
) -> DataFrame:
    """doc (all columns of docs), kept_text, n_lines, n_dropped for every row of docs.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
    least min_chars (never under 1) code points found in min_docs rows or more lose all their
    lines; empty lines always stay. A null or empty text is one empty line. Documents without
    doc_id and repeated rows count like any other. Keys are told apart by 64-bit hashes.

    What a task holds is bounded: shards have about shard_lines lines (13 bytes each), and
    shards_at_once of them are broadcast. Where there are more, documents pass once for each
    such block; a line belongs to one block, so the passes add up to the whole.
    """
    spark = docs.sparkSession
    with_checkpoints(spark)
    shared = shared_lines(docs, min_docs, min_chars).checkpoint()
    shards = max(1, -(-shared.count() // shard_lines))
    index = build_index(shared, shards).checkpoint()
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce("text", F.lit("")).alias("kept_text"),
        F.size(lines_of(F.col("text"))).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_dropped"),
    )
    for first in range(0, shards, shards_at_once):
        block = index.filter(F.col("shard").between(first, first + shards_at_once - 1)).collect()
        if first:
            out = out.checkpoint()
        lines = lines_of(F.col("kept_text"))
        drop = _over_limit(line_hashes(lines, min_chars), block, shards, min_docs, spark)
        probed = out.withColumn("drop", drop).withColumn("lines", lines)
        kept = F.filter("lines", lambda _, i: ~F.get(F.col("drop"), i))
        out = probed.select(
            "doc",
            F.array_join(kept, "\n").alias("kept_text"),
            "n_lines",
            (F.col("n_dropped") + F.size(F.filter("drop", lambda x: x))).alias("n_dropped"),
        )
    return out
