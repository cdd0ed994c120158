"""Benchmark decontamination by the q-gram lemma.

A text within k edits of an item of n characters shares at least n - q + 1 - k q of the
item's q-grams, on diagonals (text position less item position) that span at most k. Shared
q-grams are counted in bands of 2k diagonals, one every k, so that every such span lies in
a band; bands that meet the bound are verified by a banded alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import with_checkpoints

Q = 8
FILTER_BITS = 22
STRETCH = 1 << 20  # postings looked at together
WIDE = 1 << 15  # diagonals aligned together
_BASE = 0x9E3779B97F4A7C15 | 1
_NO_LETTERS = re.compile(r"[\W_]+")
MATCHES = "array<struct<item_id: bigint, n_edits: int, begin: int>>"


def normalised(text: str | None) -> str:
    """Lower-cased letters and digits, everything else one space."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.uint64)


def _grams(units: np.ndarray) -> np.ndarray:
    """A hash of the Q units from each position; Q is a power of two, so halves are joined."""
    code, width, power = units, 1, _BASE
    while width < Q:
        code = code[:-width] * np.uint64(power) + code[width:]
        width, power = 2 * width, power * power % 2**64
    return code


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(_BASE)) >> np.uint64(64 - FILTER_BITS)


def aligned(item: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> tuple[int, int] | None:
    """Fewest edits between the item and a stretch of text, with the text position where it starts.

    The path keeps to diagonals first to last; it may start and end anywhere in the text.
    None where more than the given edits are needed.
    """
    width, n, far = last - first + 1, len(item), len(item) + edits + 1
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    at = first + steps
    row[(at < 0) | (at > len(text))] = far
    padded = np.full(n + width + 1, 2**32, np.uint64)  # no unit equals it
    low, high = max(0, first), min(len(text), first + n + width)
    padded[low - first : max(low, high) - first] = text[low : max(low, high)]
    begin = at.copy()
    for i in range(n):
        # cell j of row i + 1 ends the item's first i + 1 units at text position first + i + 1 + j
        here = row + (padded[i : i + width] != item[i])
        start = begin
        up = np.append(row[1:] + 1, far)
        better = up < here
        here = np.where(better, up, here)
        start = np.where(better, np.append(begin[1:], 0), start)
        at = first + i + 1 + steps
        here[(at < 0) | (at > len(text))] = far
        run = here - steps
        least = np.minimum.accumulate(run)
        origin = np.maximum.accumulate(np.where(run == least, steps, 0))
        row, begin = least + steps, start[origin]
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return int(row[best]), int(begin[best])


@dataclass
class Items:
    """A block of benchmark items, ready to be looked for."""

    ids: np.ndarray
    units: list[np.ndarray]
    texts: list[str]
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that a match needs
    codes: np.ndarray  # distinct q-gram hashes, sorted
    offsets: np.ndarray
    owner: np.ndarray  # item of each posting
    place: np.ndarray  # its position in the item
    window: np.ndarray  # fewest diagonals a band moves on by, over the items of each code
    short: list[int]  # items with fewer than Q units

    def present(self) -> np.ndarray:
        table = np.zeros(1 << FILTER_BITS, bool)
        table[_slot(self.codes)] = True
        return table


def prepare(rows: list[tuple[int, str]], rate: float) -> Items:
    """Items from (item_id, text): k edits are allowed, k being rate times the length but never so many
    that the bound on shared q-grams falls below one. Items without letter or digit match nothing."""
    kept = [(i, t) for i, t in ((i, normalised(t)) for i, t in rows) if t]
    units = [_units(t) for _, t in kept]
    length = np.array([len(u) for u in units], np.int64)
    edits = np.maximum(0, np.minimum((rate * length).astype(np.int64), (length - Q) // Q))
    long = np.flatnonzero(length >= Q)
    codes = np.concatenate([*(_grams(units[i]) for i in long), np.zeros(0, np.uint64)])
    owner = np.concatenate([*(np.full(length[i] - Q + 1, i) for i in long), np.zeros(0, np.int64)]).astype(np.int64)
    place = np.concatenate([*(np.arange(length[i] - Q + 1) for i in long), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    distinct, first = np.unique(codes[order], return_index=True)
    steps = np.maximum(edits, 1)[owner[order]]
    return Items(
        np.array([i for i, _ in kept], np.int64), units, [t for _, t in kept], edits, length - Q + 1 - edits * Q,
        distinct, np.append(first, len(codes)), owner[order], place[order],
        np.minimum.reduceat(steps, first) if len(first) else steps, np.flatnonzero(length < Q).tolist(),
    )


def find(text: str | None, items: Items, present: np.ndarray) -> list[tuple[int, int, int]]:
    """item_id, edits and start (in the normalised text) of each item found; its best place only."""
    plain = normalised(text)
    found: dict[int, tuple[int, int]] = {}
    bounded = f" {plain} "
    for i in items.short:
        if (at := bounded.find(f" {items.texts[i]} ")) >= 0:
            found[i] = (0, at)
    units = _units(plain)
    if len(units) >= Q and len(items.codes):
        codes = _grams(units)
        spots = np.flatnonzero(present[_slot(codes)])
        number = np.minimum(np.searchsorted(items.codes, codes[spots]), len(items.codes) - 1)
        known = items.codes[number] == codes[spots]
        for i, stretches in _bands(spots[known], number[known], items).items():
            exact = plain.find(items.texts[i])
            if exact >= 0:
                found[i] = (0, exact)
                continue
            for first, last in stretches:
                hit = aligned(items.units[i], units, first, last, int(items.edits[i]))
                if hit:
                    found[i] = min(found.get(i, hit), hit)
                    if found[i][0] == 1:  # no place has none
                        break
    return sorted((int(items.ids[i]), n, at) for i, (n, at) in found.items())


def _thinned(spots: np.ndarray, number: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """The spots without those of a q-gram that repeats inside a window: its first and last one reach the same bands."""
    order = np.lexsort((spots, number))
    spots, number = spots[order], number[order]
    window = spots // items.window[number]
    new = np.append(True, (number[1:] != number[:-1]) | (window[1:] != window[:-1]))
    kept = new | np.append(new[1:], True)
    spots, number = spots[kept], number[kept]
    order = np.argsort(spots, kind="stable")
    return spots[order], number[order]


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows of some columns of whole numbers, in order."""
    lows = [int(c.min()) for c in columns]
    sizes = [int(c.max()) - low + 1 for c, low in zip(columns, lows, strict=True)]
    if float(np.prod(np.array(sizes, float))) >= 2.0**62:
        order = np.lexsort(columns[::-1])
        rows = [c[order] for c in columns]
        new = np.append(True, np.any([r[1:] != r[:-1] for r in rows], axis=0))
        return tuple(r[new] for r in rows)
    key = columns[0] - lows[0]
    for c, low, size in zip(columns[1:], lows[1:], sizes[1:], strict=True):
        key = key * size + (c - low)
    key = np.unique(key)
    out = []
    for low, size in zip(lows[:0:-1], sizes[:0:-1], strict=True):
        key, rest = np.divmod(key, size)
        out.append(rest + low)
    return (key + lows[0], *out[::-1])


def _bands(spots: np.ndarray, number: np.ndarray, items: Items) -> dict[int, list[tuple[int, int]]]:
    """For each item the runs of diagonals, widened by its edits, whose bands hold enough different q-grams of the item.

    The text is gone through in stretches of about STRETCH postings. Places met in a band are kept once, and only
    while the band can still meet more, so memory follows the items and not the text.
    """
    times = items.offsets[number + 1] - items.offsets[number]
    if int(times.sum()) > STRETCH:
        spots, number = _thinned(spots, number, items)
        times = items.offsets[number + 1] - items.offsets[number]
    if not len(spots):
        return {}
    upto = np.cumsum(times)
    cuts = np.unique(np.searchsorted(upto, np.arange(STRETCH, int(upto[-1]) + STRETCH, STRETCH), side="left") + 1)
    pieces = [(int(a), int(b)) for a, b in zip([0, *cuts[:-1]], np.minimum(cuts, len(spots)), strict=True) if a < b]

    def postings(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Spot and posting number of every posting of the spots from a to b."""
        n = times[a:b]
        first = np.repeat(items.offsets[number[a:b]], n)
        return np.repeat(spots[a:b], n), first + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    met = sum(np.bincount(items.owner[postings(a, b)[1]], minlength=len(items.ids)) for a, b in pieces)
    often = met >= items.least
    step, length = np.maximum(items.edits, 1), items.least + Q - 1 + items.edits * Q
    none = np.zeros(0, np.int64)
    open_ = (none, none, none)  # item, band, place
    full: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in pieces:
        where, posting = postings(a, b)
        some = often[items.owner[posting]]
        item, place = items.owner[posting[some]], items.place[posting[some]]
        band = np.floor_divide(where[some] - place, step[item])
        if len(item):
            item, band, place = _distinct(item, band, place)
            item, band, place = (np.concatenate(x) for x in ((item, item, open_[0]), (band, band - 1, open_[1]), (place, place, open_[2])))
            open_ = _distinct(item, band, place)
        item, band, place = open_
        if not len(item):
            continue
        # a band is done when its last diagonal lies more than the item before the next spot
        done = (band + 2) * step[item] + length[item] < spots[b] if b < len(spots) else np.ones(len(item), bool)
        ready, at = item[done], band[done]
        starts = np.flatnonzero(np.append(True, (ready[1:] != ready[:-1]) | (at[1:] != at[:-1]))) if len(ready) else none
        size = np.diff(np.append(starts, len(ready)))
        enough = starts[size >= items.least[ready[starts]]] if len(ready) else none
        full.append((ready[enough], at[enough]))
        open_ = tuple(c[~done] for c in open_)
    item, band = (np.concatenate(x) for x in zip(*full, strict=True)) if full else (none, none)
    out: dict[int, list[tuple[int, int]]] = {}
    for at in np.lexsort((band, item)).tolist():
        i, b = int(item[at]), int(band[at])
        k, runs = int(step[i]), out.setdefault(int(item[at]), [])
        first, last = b * k - int(items.edits[i]), (b + 2) * k - 1 + int(items.edits[i])
        if runs and first <= runs[-1][1] + 1 and last - runs[-1][0] < WIDE:
            runs[-1] = (runs[-1][0], last)
        else:
            runs.append((first, last))
    return out


def _matches(text: Column, items: Items, spark) -> Column:
    held = spark.sparkContext.broadcast(items)

    @F.pandas_udf(T._parse_datatype_string(MATCHES))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = held.value
        present = block.present()
        for texts in batches:
            hits = ([{"item_id": i, "n_edits": n, "begin": at} for i, n, at in find(t, block, present)] for t in texts)
            yield pd.Series(list(hits), dtype=object)

    return search(text)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """doc (all columns of docs), matches for every row of docs; matches is empty for a clean one.

    docs: text; items: item_id, text. A match is an item whose whole normalised text (lower
    case, letters and digits with single spaces) lies in the document's with at most rate times
    its length in edits. Items under Q characters match as whole words. Null and empty texts on
    either side match nothing, items without id are left out, repeated items are one match,
    documents are searched to their end. The items are broadcast in blocks of about
    block_chars characters; where there are more, documents pass once for each block.
    """
    spark = docs.sparkSession
    listed = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    chars = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("text"),
        F.array().cast(MATCHES).alias("matches"),
    )
    for block in range(blocks):
        mine = listed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        prepared = prepare([tuple(r) for r in mine.orderBy("item_id", "text").collect()], rate)
        if block:
            with_checkpoints(spark)
            out = out.checkpoint()
        hits = _matches(F.col("text"), prepared, spark)
        joined = F.concat("matches", "new")
        out = out.withColumn("new", hits).withColumn("matches", joined if block else F.col("new")).drop("new")
    return out.drop("text")
