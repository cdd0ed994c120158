"""SimHash near-duplicates: covering locality-sensitive hashing over 64-bit fingerprints.

A fingerprint takes part in 2^(r+1) - 1 tables. Table v keeps the bits whose code m(bit),
a vector of r + 1 bits, has an odd inner product with v. Two fingerprints that differ in
at most r bits give at most r codes, so some nonzero v is orthogonal to all of them: that
table keeps none of the differing bits and both land in one bucket. No pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.components import components
from docloom.session import with_checkpoints

BITS = 64
ROW_KEY = ["no_id", "id", "text_hash"]
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle_words: int) -> list[int]:
    """XXH64 of each shingle of one text, repeats included; empty for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    return [
        digest(joined[a:b], 42)
        for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    ]


def fingerprint(text: str | None, shingle_words: int) -> int:
    """Signed 64-bit SimHash of one text; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, shingle_words))


def fingerprint_of(hashes: list[int] | np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes; 0 for none."""
    if not len(hashes):
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(text: Column, shingle_words: int = 3) -> Column:
    """SimHash of whole texts: a bit is set when it is set in over half of the shingle hashes."""

    @F.pandas_udf(T.LongType())
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return of_texts(text)


def covering_masks(free: list[int], radius: int) -> list[int]:
    """The bits each table keeps, for fingerprints that may differ in the free bits."""
    size = (1 << (radius + 1)) - 1
    codes = {bit: i % size + 1 for i, bit in enumerate(free)}
    return [sum(1 << bit for bit, code in codes.items() if (code & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask_children(radius: int, levels: int) -> dict[int, list[int]]:
    """For each kept-bits mask, the masks a hot bucket of it is split into."""
    children: dict[int, list[int]] = {}
    front = [0]
    for _ in range(levels):
        below = []
        for kept in front:
            free = [b for b in range(BITS) if not kept >> b & 1]
            children[kept] = sorted({kept | m for m in covering_masks(free, radius)})
            below += children[kept]
        front = list(dict.fromkeys(below))
    return children


def _split(rows: DataFrame, children: dict[int, list[int]]) -> DataFrame:
    """Every row (mask, fp) in the narrower tables below its mask."""
    table = F.create_map(*[x for kept, below in children.items() for x in (F.lit(_signed(kept)), F.array(*[F.lit(_signed(m)) for m in below]))])
    return rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))


def _bucket() -> Column:
    return F.col("fp").bitwiseAND(F.col("mask"))


def bucket_rows(points: DataFrame, radius: int, hot_rows: int) -> DataFrame:
    """fp, mask: each fingerprint in its tables; only buckets with company, none above hot_rows.

    A bucket above hot_rows is split by covering masks over the bits it leaves free, which
    keeps every pair. Each split leaves about three in seven of the free bits; its members
    are distinct, so three levels end at no more than 2^6 members whatever the input.
    """
    levels = 3
    children = _mask_children(radius, levels)
    below = [0]
    level = points.withColumn("mask", F.lit(0).cast("bigint"))
    done = None
    for depth in range(levels):
        level = _split(level, {m: children[m] for m in below}).checkpoint()
        below = list(dict.fromkeys(c for m in below for c in children[m]))
        counts = level.groupBy("mask", _bucket().alias("value")).agg(F.count("*").alias("n")).filter("n > 1")
        marked = level.withColumn("value", _bucket()).join(counts, ["mask", "value"])
        last = depth == levels - 1
        kept = (marked if last else marked.filter(F.col("n") <= hot_rows)).select("fp", "mask")
        done = kept if done is None else done.unionByName(kept)
        hot = counts.filter(F.col("n") > hot_rows)
        if last or hot.isEmpty():
            return done
        level = marked.filter(F.col("n") > hot_rows).select("fp", "mask").checkpoint()
    return done


def _bucket_edges(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member of one bucket with the least member it is joined to inside the bucket."""
    bits = points.view(np.uint64)  # signed numbers would count the bits of their absolute values
    if len(points) == 2:
        near = int(bits[0] ^ bits[1]).bit_count() <= radius
        return (points[1:], points[:1]) if near else (points[:0], points[:0])
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(points))
    while True:
        least = np.where(near, label[None, :], len(points)).min(axis=1)
        if np.array_equal(least, label):
            break
        label = least
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def links(points: DataFrame, radius: int, hot_rows: int = 256) -> DataFrame:
    """a, b: edges that join all distinct fingerprints within the radius; at most one a member and bucket."""
    rows = bucket_rows(points, radius, hot_rows).withColumn("value", _bucket())
    rows = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def join_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rest is None or not len(rest):
                continue
            mask, value, fp = (rest[c].to_numpy("int64") for c in ("mask", "value", "fp"))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(fp)])) if batch is None else np.concatenate(([0], cuts))
            a, b = [], []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if j - i > 1:
                    x, y = _bucket_edges(fp[i:j], radius)
                    a.append(x)
                    b.append(y)
            rest = rest.iloc[bounds[-1] :]
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.select("mask", "value", "fp").mapInPandas(join_buckets, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def near_groups(docs: DataFrame, radius: int = 2, shingle_words: int = 3, hot_rows: int = 256) -> DataFrame:
    """doc_id, text_hash, fingerprint (bigint), group_id, component_id for every row of docs (doc_id, text).

    Equal fingerprints are one point from the start, so copies are never paired. Null or
    empty texts and texts of white space have fingerprint 0 and are linked like any
    other. Repeated rows stay. group_id is a fingerprint of the group, component_id its least
    doc_id. A row without doc_id is grouped but never names a group; a group of such rows only
    has component_id null. Other columns are not looked at.
    """
    with_checkpoints(docs.sparkSession)
    marked = docs.select(
        "doc_id", text_hash(F.col("text")).alias("text_hash"), fingerprints(F.col("text"), shingle_words).alias("fp")
    ).checkpoint()
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(points.select("fp"), radius, hot_rows))
    rooted = points.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", F.col("root").alias("group_id"), "component_id")
    return marked.join(named, "fp").select(
        "doc_id", "text_hash", F.col("fp").alias("fingerprint"), "group_id", "component_id"
    )


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column, hashed: Column) -> list[Column]:
    """ROW_KEY of a row: orders rows by doc_id, those without one last, then by the hash of the text."""
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), hashed.alias("text_hash")]


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each group of groups (doc_id, text_hash, group_id), all columns: that with the least doc_id.

    Rows without doc_id come last. Among rows that share the least doc_id the text with the least
    hash stays, and of repeated rows one. Texts pass one shuffle, by document.
    """
    first = groups.groupBy("group_id").agg(F.min(F.struct(*row_key(F.col("doc_id"), F.col("text_hash")))).alias("first"))
    keepers = first.select("first.*").distinct()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(F.col("doc_id"), text_hash(F.col("text")))
    )
    return whole.join(keepers, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).select("doc.*")
