"""Keyword expressions over page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv

# Letters and digits of any script make up a word; everything else separates.
WORD_GAP = r"[^\p{L}\p{N}]+"
DIGITS_ONLY = r"^\p{Nd}+$"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
# Unicode word boundaries and digits, as the published patterns assume.
UNICODE = "(?U)"

_DROPPED_WORDS = [w for w in fv.STOPWORDS if w not in fv.BUSINESS_TERMS]


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Distinct lower-case words in first-seen order, without stopwords, numbers and short words."""
    words = F.array_distinct(F.split(F.lower(or_empty(text)), WORD_GAP))
    return F.filter(
        words,
        lambda w: (F.length(w) > 2) & ~w.isin(_DROPPED_WORDS) & ~w.rlike(DIGITS_ONLY),
    )


def _all_matches(text: Column, pattern: str, marker: str | None = None) -> Column:
    """All matches; a text without the marker is not searched at all."""
    found = F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(0))
    if marker is not None:
        found = F.when(F.contains(text, F.lit(marker)), found).otherwise(no_strings())
    return F.coalesce(found, no_strings())


def emails(text: Column) -> Column:
    return F.transform(_all_matches(text, fv.EMAIL_IN_TEXT, "@"), F.lower)


def phones(text: Column) -> Column:
    return _all_matches(text, fv.PHONE_IN_TEXT)


def urls(text: Column) -> Column:
    return F.transform(_all_matches(text, fv.URL_IN_TEXT, "://"), F.lower)


def prices(text: Column) -> Column:
    return _all_matches(text, fv.PRICE_IN_TEXT, "$")


def capitalised_words(text: Column) -> Column:
    return _all_matches(text, fv.CAPITALISED_WORD)


def entities(text: Column) -> Column:
    return F.concat(emails(text), phones(text), urls(text), prices(text))


def _neighbours(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    joined = F.slice(words, 1, F.greatest(count, F.lit(0)))
    for k in range(1, n):
        # neighbours side by side: the words are not looked up again for each position
        joined = F.zip_with(joined, F.slice(words, k + 1, F.greatest(count, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(count > 0, joined).otherwise(no_strings())


def ngrams(words: Column, n: int) -> Column:
    """Runs of n neighbouring words joined by an underscore.

    The words are bound to a name: an expression that makes them is evaluated once, not at each mention.
    """
    return F.get(F.transform(F.array(words), lambda w: _neighbours(w, n)), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct search keywords of a text: its tokens and the parts of its entities.

    n-grams are split into their words again before indexing, so they never add
    a keyword and are left out here; `ngrams` offers them on their own.
    """
    parts = F.flatten(
        F.transform(entities(text), lambda e: F.split(F.translate(F.lower(e), "_-", "  "), " "))
    )
    return F.array_distinct(F.concat(tokens(text), F.filter(parts, lambda p: F.length(p) > 2)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def snippet_at(text: Column, position: Column, keyword: Column) -> Column:
    """Text around a 1-based hit position; position 0 means the keyword was not found."""
    side = fv.SNIPPET_SIDE_CHARS
    chars = F.length(text)
    start = F.greatest(F.lit(0), position - 1 - side)
    end = F.least(chars, position - 1 + F.length(keyword) + side)
    cut = F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        F.substring(text, start + 1, end - start),
        F.when(end < chars, F.lit("...")).otherwise(F.lit("")),
    )
    return F.when(position > 0, strip(F.translate(cut, "\n", " "))).otherwise(
        F.substring(text, 1, 2 * side)
    )


def relevance(keyword: Column, hits: Column, position: Column) -> Column:
    """Frequency share (capped), business-term bonus and early-position bonus, at most 1."""
    zero = F.lit(0.0)
    frequency = F.least(hits * F.lit(fv.HIT_WEIGHT), F.lit(fv.HIT_WEIGHT_CAP))
    business = F.when(keyword.isin(fv.BUSINESS_TERMS), F.lit(fv.BUSINESS_BONUS)).otherwise(zero)
    in_head = (position > 0) & (position + F.length(keyword) - 1 <= fv.HEAD_CHARS)
    head = F.when(in_head, F.lit(fv.HEAD_BONUS)).otherwise(zero)
    return F.least(frequency + business + head, F.lit(1.0))
