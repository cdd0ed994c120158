"""Substring hits of many keywords in one text.

A keyword counts wherever it occurs in the lower-case text, also inside longer
words. Searching keyword by keyword costs keywords x text length, which built-in
string functions cannot avoid; one pass with a multi-pattern automaton costs text
length plus hits. That one pass goes over Arrow batches and hands back rows; everything around
it stays a column expression.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from docloom.functions import fixed_values as fv

try:
    import ahocorasick
except ImportError:  # the same results by runs, also linear in the text
    ahocorasick = None

# Ship these helpers with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDE_CHARS = fv.SNIPPET_SIDE_CHARS
# The frequency share is capped at the third hit, so no more are counted.
COUNTED_HITS = 3
_FEW = 8
SLICE_WORDS = 8192  # keyword rows that leave at once
SLICE_PAGES = 64  # pages whose strings are converted at once
GATHERED_ROWS = 1 << 18  # keyword rows that are brought together by keyword at once
_HEAD = 3  # shorter words are searched one by one
_RUN = re.compile(r"[^\W_]+")


def _by_search(lowered: str, words: list[str]) -> tuple[list[int], list[int]]:
    counts, firsts = [], []
    for word in words:
        first = at = lowered.find(word)
        n = 0
        while at >= 0 and n < COUNTED_HITS:
            n += 1
            at = lowered.find(word, at + len(word))
        counts.append(n)
        firsts.append(first + 1)
    return counts, firsts


def _by_runs(lowered: str, words: list[str], counts: list[int], firsts: list[int], which: list[int]) -> None:
    """Hits of words made of letters and digits: each lies within one run of these in the text.

    A run that occurs often is searched once; work is linear in the text, with one look-up for each
    place of a different run where a word of some length may begin.
    """
    index = {words[i]: i for i in which}
    sizes: dict[str, set[int]] = {}
    for word in index:
        sizes.setdefault(word[:_HEAD], set()).add(len(word))
    ordered = {head: tuple(sorted(some)) for head, some in sizes.items()}
    seen: dict[str, list[int]] = {}
    for match in _RUN.finditer(lowered):
        run = match[0]
        if run in seen:
            seen[run][0] += 1
        else:
            seen[run] = [1, match.start()]
    for run, (times, start) in seen.items():
        free: dict[int, int] = {}  # hits of one word must not overlap
        for at in range(len(run) - _HEAD + 1):
            for size in ordered.get(run[at : at + _HEAD], ()):
                i = index.get(run[at : at + size])
                if i is not None and at >= free.get(i, 0):
                    free[i] = at + size
                    counts[i] = min(COUNTED_HITS, counts[i] + times)
                    if firsts[i] == 0 or start + at + 1 < firsts[i]:
                        firsts[i] = start + at + 1


def _by_automaton(lowered: str, words: list[str]) -> tuple[list[int], list[int]]:
    automaton = ahocorasick.Automaton()
    for i, word in enumerate(words):
        automaton.add_word(word, (i, len(word)))
    automaton.make_automaton()
    counts, firsts = [0] * len(words), [0] * len(words)
    free_from = [0] * len(words)  # hits of one keyword must not overlap
    for end, (i, size) in automaton.iter(lowered):
        n = counts[i]
        if n < COUNTED_HITS:
            start = end - size + 1
            if start >= free_from[i]:
                counts[i] = n + 1
                free_from[i] = end + 1
                if n == 0:
                    firsts[i] = start + 1
    return counts, firsts


def count_hits(lowered: str, words: list[str]) -> tuple[list[int], list[int]]:
    """Hit counts (up to three) and 1-based first positions (0: none) of distinct words."""
    if len(words) <= _FEW:
        return _by_search(lowered, words)
    if ahocorasick is not None:
        return _by_automaton(lowered, words)
    return _without_package(lowered, words)


def _without_package(lowered: str, words: list[str]) -> tuple[list[int], list[int]]:
    counts, firsts = [0] * len(words), [0] * len(words)
    plain = [i for i, w in enumerate(words) if len(w) >= _HEAD and _RUN.fullmatch(w)]
    _by_runs(lowered, words, counts, firsts, plain)
    others = sorted(set(range(len(words))).difference(plain))
    for i, n, first in zip(others, *_by_search(lowered, [words[i] for i in others])):
        counts[i], firsts[i] = n, first
    return counts, firsts


def cut_snippet(text: str, keyword: str, position: int) -> str:
    if position == 0:
        return text[: 2 * SIDE_CHARS]
    start = max(0, position - 1 - SIDE_CHARS)
    end = min(len(text), position - 1 + len(keyword) + SIDE_CHARS)
    cut = ("..." if start > 0 else "") + text[start:end] + ("..." if end < len(text) else "")
    return cut.replace("\n", " ").strip()


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, list[str]]]:
    """Number, text, first keyword's place and keywords of each page that has keywords. Strings are converted for SLICE_PAGES at once."""
    for start in range(0, batch.num_rows, SLICE_PAGES):
        part = batch.slice(start, SLICE_PAGES)
        keywords = part.column("keyword")
        ends = keywords.offsets.to_numpy()
        flat = keywords.flatten().to_numpy(zero_copy_only=False)
        for i, text in enumerate(part.column("text").to_numpy(zero_copy_only=False)):
            if ends[i] < ends[i + 1]:
                yield start + i, text or "", ends[i], flat[ends[i] - ends[0] : ends[i + 1] - ends[0]].tolist()


def _rows(with_length: bool = False, with_text: bool = False) -> Callable:
    """What turns batches of pages into batches of about SLICE_WORDS keyword rows, also where one page has more keywords."""

    def made(batch: pa.RecordBatch, runs: list[tuple[int, int, int]], hits: list, positions: list, shown: list) -> pa.RecordBatch:
        pages, starts, sizes = (np.array(x) for x in zip(*runs))
        words = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        pages = pa.array(np.repeat(pages, sizes))
        columns = {name: batch.column(name).take(pages) for name in ("doc_id", "page_number")}
        columns["keyword"] = batch.column("keyword").values.take(pa.array(words))
        if with_text:
            return pa.RecordBatch.from_pydict(columns | {"snippet": pa.array(shown, pa.string())})
        columns |= {"hits": pa.array(hits, pa.int32()), "position": pa.array(positions, pa.int32())}
        if with_length:
            columns["snippet_chars"] = pa.array([len(s) for s in shown], pa.int32())
        return pa.RecordBatch.from_pydict(columns)

    def keyword_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, hits, positions, shown = [], [], [], []
            for page, text, start, words in _pages(batch):
                counts, firsts = count_hits(text.lower(), words)
                for at in range(0, len(words), SLICE_WORDS):
                    to = min(len(words), at + SLICE_WORDS)
                    runs.append((page, start + at, to - at))
                    hits += counts[at:to]
                    positions += firsts[at:to]
                    if with_length or with_text:
                        shown += [cut_snippet(text, w, p) for w, p in zip(words[at:to], firsts[at:to])]
                    if len(hits) >= SLICE_WORDS:
                        yield made(batch, runs, hits, positions, shown)
                        runs, hits, positions, shown = [], [], [], []
            if runs:
                yield made(batch, runs, hits, positions, shown)

    return keyword_rows


def gather(rows: pa.Table) -> pa.RecordBatch:
    """keyword, refs: one row for each keyword of the rows, its refs in the order of the rows."""
    coded = rows.column("keyword").combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.bincount(codes, minlength=len(coded.dictionary))
    order = pa.array(np.argsort(codes, kind="stable"))
    rest = rows.drop_columns("keyword").take(order).combine_chunks()
    refs = pa.StructArray.from_arrays([c.combine_chunks() for c in rest.columns], rest.column_names)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), refs)
    return pa.RecordBatch.from_pydict({"keyword": coded.dictionary, "refs": lists})


def gathered(rows: Callable) -> Callable:
    """What brings the keyword rows of each GATHERED_ROWS or so together by keyword. Memory follows that number."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in rows(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= GATHERED_ROWS:
                yield gather(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield gather(pa.Table.from_batches(held))

    return lists


def _mapped(pages: DataFrame, rows: Callable, added: str) -> DataFrame:
    kinds = ", ".join(f"{name} {pages.schema[name].dataType.simpleString()}" for name in ("doc_id", "page_number"))
    read = pages.select("doc_id", "page_number", "text", "keyword")
    return read.mapInArrow(rows, f"{kinds}, keyword string, {added}")


def keyword_hits(pages: DataFrame, with_length: bool = False) -> DataFrame:
    """doc_id, page_number, keyword, hits, position (and snippet_chars): a row for each keyword of a page.

    pages: doc_id, page_number, text, keyword (array). Rows leave in small batches, so that memory does not follow the pages' number.
    """
    return _mapped(pages, _rows(with_length), "hits int, position int" + ", snippet_chars int" * with_length)


def _refs(pages: DataFrame) -> str:
    kinds = ", ".join(f"{name}: {pages.schema[name].dataType.simpleString()}" for name in ("doc_id", "page_number"))
    return f"keyword string, refs array<struct<{kinds}, hits: int, position: int>>"


def keyword_hit_lists(pages: DataFrame) -> DataFrame:
    """keyword, refs (doc_id, page_number, hits, position): the rows of `keyword_hits`, those of a keyword in some lists.

    A list is never longer than GATHERED_ROWS and one slice; a keyword has a list in each run of pages that holds it.
    """
    read = pages.select("doc_id", "page_number", "text", "keyword")
    return read.mapInArrow(gathered(_rows()), _refs(pages))


def gathered_hits(rows: DataFrame) -> DataFrame:
    """The lists of `keyword_hit_lists` from rows of doc_id, page_number, keyword, hits, position."""
    read = rows.select("doc_id", "page_number", "keyword", "hits", "position")
    return read.mapInArrow(gathered(lambda batches: batches), _refs(rows))


def keyword_snippets(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, keyword, snippet: a row for each keyword of a page."""
    return _mapped(pages, _rows(with_text=True), "snippet string")
