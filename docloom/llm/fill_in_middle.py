"""Fill-in-middle: texts cut at two unit ranks and reordered around sentinels.

A unit is a run of A-Z and a-z, or any other single code point. An indexable skip list holds
the units of a text: every link of a lane carries how many units and how many code points it
passes. A rank is reached by going along a lane while the accumulated units allow it, then one
lane down; the code points passed on the way are the place of the cut. The texts themselves
are cut and joined by built-in functions: only counts and places leave the Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPARSITY = 2  # binary logarithm of the nodes of a lane for one of the lane above
CUTS = "n bigint, first bigint, second bigint"


def _lane_heights(n: int) -> np.ndarray:
    """In how many express lanes each node takes part: a fixed scatter of the node numbers, so reruns agree."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    lowest = x & (~x + np.uint64(1))
    return np.where(x == 0, 64, np.bitwise_count(lowest - np.uint64(1))).astype(np.int64) // SPARSITY


class SkipList:
    """The units of one text, found by rank. A lane is two arrays of link widths and one of nodes below."""

    def __init__(self, points: np.ndarray):
        """points: code points of each unit."""
        self.n = len(points)
        self.lanes = [(np.ones(self.n, np.int64), points.astype(np.int64), None)]
        heights = _lane_heights(self.n)
        level = 1
        while len(heights) > 4:
            taking_part = heights >= level
            taking_part[0] = True  # the head stands in every lane
            below = np.flatnonzero(taking_part)
            if len(below) == len(heights):
                break
            units, width, _ = self.lanes[-1]
            self.lanes.append((np.add.reduceat(units, below), np.add.reduceat(width, below), below))
            heights = heights[below]
            level += 1

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank; those of the whole text at rank n."""
        passed, place, node = 0, 0, 0
        for units, points, below in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                place += int(points[node])
                node += 1
            if passed == rank:
                break
            if below is not None:
                node = int(below[node])
        return place


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit of a text."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lower = code | np.uint32(0x20)
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    first = np.ones(len(code), bool)
    first[1:] = ~(letter[1:] & letter[:-1])
    starts = np.flatnonzero(first)
    return np.diff(np.append(starts, len(code)))


def cuts(text: str, one: int, two: int) -> tuple[int, int, int]:
    """Number of units, and the places of the cuts that two hash values choose, the smaller first."""
    units = SkipList(unit_widths(text))
    a, b = sorted((one % (units.n + 1), two % (units.n + 1)))
    return units.n, units.seek(a), units.seek(b)


def _cuts(text: Column, one: Column, two: Column) -> Column:
    @F.pandas_udf(CUTS)
    def of_texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ones, twos in batches:
            found = [cuts(*row) for row in zip(texts, ones, twos, strict=True)]
            yield pd.DataFrame(found, columns=["n", "first", "second"], dtype="int64")

    return of_texts(text, one, two)


def _hash_values(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of sha256(seed:doc_id), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc (all columns), n, form, prefix_chars, middle_chars, output for every row of docs (doc_id, text).

    Prefix, middle and suffix lie between the cuts; n counts units. Form psm is prefix, suffix,
    middle, each behind its sentinel; spm starts with the suffix. A text that is empty (null counts
    as empty) or holds a sentinel stays plain, as does plain_percent of the others; lengths are
    null then. Cuts and form follow from seed and doc_id alone: repeated rows agree, rows without
    doc_id hash the empty id. Texts are never shortened; one text's widths are held at a time.
    """
    text, hashes = F.coalesce(F.col("text"), F.lit("")), _hash_values(F.col("doc_id"), seed)
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(text, F.lit(sentinel))
    plain = (text == "") | held | (hashes[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(hashes[3] % 100 < spm_percent, "spm").otherwise("psm")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    cut = docs.select(doc, form.alias("form"), _cuts(text, hashes[0], hashes[1]).alias("cut"))
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    first, second = F.col("cut.first"), F.col("cut.second")
    piece = lambda start, size: F.substr(text, (start + 1).cast("int"), size.cast("int"))
    prefix, middle = piece(F.lit(0), first), piece(first, second - first)
    suffix = piece(second, F.length(text))
    mark = F.lit
    output = (
        F.when(F.col("form") == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle))
        .otherwise(text)
    )
    is_cut = F.col("form") != "plain"
    return cut.select(
        "doc", F.col("cut.n").alias("n"), "form", F.when(is_cut, first).alias("prefix_chars"),
        F.when(is_cut, second - first).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again. No sentinel is in the text and none overlaps itself, so each is found where it was put."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    left = lambda second: F.substr(F.substring_index(head, second, 1), F.lit(len(PREFIX) + 1))
    right = lambda second: F.substring_index(head, second, -1)
    return (
        F.when(form == "psm", F.concat(left(SUFFIX), middle, right(SUFFIX)))
        .when(form == "spm", F.concat(right(PREFIX), middle, left(PREFIX)))
        .otherwise(output)
    )
