"""Keyword expressions against plain Python rules on the same texts."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import hits
from docloom.functions import text as tx
from docloom.operators import index

TEXTS = [
    "Contact info@a-b.com or 555-123-4567, price $1,200.50",
    "The quick-brown fox_jumps over the lazy dog 2024 and 12 foxes",
    "Café déjà-vu ÜBER straße 123 naïve naïve",
    "",
    "   \n\t ",
    "See https://Example.com/A_b?x=1 and http://x.y/z. Call 5551234567 or 555.123.4567!",
    "a.b@c.de e@f.g Upper@Case.ORG $5 $5.00 $1,000 price PRICE prices",
    "x" * 3000 + " tail",
]


def expected_keywords(text):
    words = re.sub(r"[^\w\s]", " ", re.sub(r"[_-]", " ", text.lower())).split()
    found = {w for w in words if w not in fv.STOPWORDS and not w.isdigit() and len(w) > 2}
    entities = [e.lower() for e in re.findall(fv.EMAIL_IN_TEXT, text)]
    entities += re.findall(fv.PHONE_IN_TEXT, text)
    entities += [u.lower() for u in re.findall(fv.URL_IN_TEXT, text)]
    entities += re.findall(fv.PRICE_IN_TEXT, text)
    for entity in entities:
        found |= {p for p in entity.replace("_", " ").replace("-", " ").split() if len(p) > 2}
    return found


def column(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[1] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_keywords_follow_the_rules(spark):
    for text, got in zip(TEXTS, column(spark, tx.keywords(F.col("text")), TEXTS)):
        assert set(got) == expected_keywords(text)
        assert len(got) == len(set(got))


def test_published_keyword_case(spark):
    got = set(column(spark, tx.keywords(F.col("text")), TEXTS)[0])
    assert {"contact", "info@a", "b.com", "555", "123", "4567", "price", "$1,200.50"} <= got
    assert "or" not in got


def test_null_text_has_no_keywords(spark):
    assert column(spark, tx.keywords(F.col("text")), [None]) == [[]]


def test_entities(spark):
    text = [TEXTS[6]]
    assert column(spark, tx.emails(F.col("text")), text) == [["a.b@c.de", "upper@case.org"]]
    assert column(spark, tx.prices(F.col("text")), text) == [["$5", "$5.00", "$1,000"]]
    assert column(spark, tx.urls(F.col("text")), [TEXTS[5]]) == [["https://example.com/a_b?x=1", "http://x.y/z."]]
    assert column(spark, tx.phones(F.col("text")), [TEXTS[5]]) == [["5551234567", "555.123.4567"]]


def test_ngrams_make_their_words_once(spark):
    frame = spark.createDataFrame([("a b c",)], "text string").select(tx.ngrams(F.split("text", " +"), 3).alias("runs"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert frame.first()["runs"] == ["a_b_c"]


def test_ngrams(spark):
    words = F.split("text", " ")
    assert column(spark, tx.ngrams(words, 2), ["a b c", "a"]) == [["a_b", "b_c"], []]
    assert column(spark, tx.ngrams(words, 3), ["a b c", "a b"]) == [["a_b_c"], []]


def test_capitalised_words(spark):
    assert column(spark, tx.capitalised_words(F.col("text")), ["New York in MAY by Zoé"]) == [["New", "York"]]


@pytest.mark.parametrize("times, frequency", [(1, 0.2), (3, 0.6), (9, 0.6)])
def test_relevance_parts(spark, times, frequency):
    df = spark.createDataFrame([("tree", min(times, 3), 700), ("price", min(times, 3), 1)], "k string, n int, p int")
    got = [r[0] for r in df.select(tx.relevance(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(frequency)
    assert got[1] == pytest.approx(min(frequency + 0.2 + 0.2, 1.0))


def expected_relevance(keyword, text):
    lowered = text.lower()
    business = 0.2 if keyword in fv.BUSINESS_TERMS else 0.0
    head = 0.2 if keyword in lowered[:500] else 0.0
    return min(min(lowered.count(keyword) * 0.2, 0.6) + business + head, 1.0)


def test_postings_match_direct_counting(spark):
    from docloom.operators import index

    texts = [*TEXTS, ("filler words here " * 40) + "price rarely seen phrase\nprice " + "more text " * 50]
    pages = spark.createDataFrame(
        [(f"d{i}", f"a/d{i}.pdf", 1, t) for i, t in enumerate(texts)],
        "doc_id string, source_file string, page_number long, text string",
    )
    for row in index.postings(pages).collect():
        text = texts[int(row["doc_id"][1:])]
        assert row["relevance"] == expected_relevance(row["keyword"], text)
        assert row["position"] == text.lower().find(row["keyword"]) + 1
    snippets = {(r["doc_id"], r["keyword"]): r["snippet"] for r in index.posting_snippets(pages).collect()}
    cut = snippets[("d8", "price")]
    assert cut.startswith("...") and cut.endswith("...") and "\n" not in cut and "price" in cut
    for (doc, keyword), snippet in snippets.items():
        assert snippet == hits.cut_snippet(texts[int(doc[1:])], keyword, texts[int(doc[1:])].lower().find(keyword) + 1)


def test_snippet_column_equals_helper(spark):
    text = ("abc def " * 40) + "needle\nin hay " + ("xyz " * 60)
    at = text.find("needle") + 1
    df = spark.createDataFrame([(text, at, "needle"), (text, 0, "absent"), ("short needle", 7, "needle")], "t string, p int, k string")
    got = [r[0] for r in df.select(tx.snippet_at(F.col("t"), F.col("p"), F.col("k"))).collect()]
    assert got == [hits.cut_snippet(text, "needle", at), text[:200], "short needle"]


@settings(max_examples=200, deadline=None)
@given(st.text("abé@ ", max_size=60), st.lists(st.text("abé@", min_size=1, max_size=4), unique=True, max_size=14))
def test_automaton_equals_repeated_search(text, words):
    expected = [min(text.count(w), hits.COUNTED_HITS) for w in words], [text.find(w) + 1 for w in words]
    assert hits._by_search(text, words) == expected
    if words:
        assert hits.count_hits(text, words) == expected
        assert hits._without_package(text, words) == expected


def test_keyword_rows_leave_in_bounded_batches():
    """Memory of a task follows SLICE_WORDS, not the pages or the keywords of a page that one Arrow batch holds."""
    long = [f"word{i}" for i in range(3 * hits.SLICE_WORDS)]
    words = [["alpha"], long, [], ["beta", "gamma"]]
    texts = ["alpha beta", " ".join(long), "x", None]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": ["a", "b", "c", "d"], "page_number": [1, 2, 3, 4], "text": texts, "keyword": pa.array(words, pa.list_(pa.string())),
    })
    for shift in (0, 1):  # also a slice whose lists do not begin at zero
        part = batch.slice(shift)
        got = list(hits._rows(with_text=True)([part]))
        assert len(got) > 2 and all(b.num_rows <= hits.SLICE_WORDS + 1 for b in got)
        rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
        assert [r[:3] for r in rows] == [(d, n, w) for d, n, some in list(zip("abcd", [1, 2, 3, 4], words))[shift:] for w in some]
        assert rows[-1] == ("d", 4, "gamma", "") and all(r[2] in r[3] for r in rows[:-2])
        plain = pa.Table.from_batches(hits._rows(with_length=True)([part])).to_pylist()
        assert [r["snippet_chars"] for r in plain] == [len(r[3]) for r in rows]


@pytest.mark.parametrize("named", [3, 100])
def test_postings_of_terms_are_those_of_all(spark, named, monkeypatch):
    monkeypatch.setattr(index, "NAMED_TERMS", named)
    pages = spark.createDataFrame([("a", 1, "price of the blue price"), ("b", 1, "nothing"), ("c", 1, None)], "doc_id string, page_number long, text string")
    terms = spark.createDataFrame([("price",), ("price",), ("blue",), ("absent",), ("none",), (None,)], "keyword string")
    found, every = index.postings(pages, terms=terms), index.postings(pages)
    assert sorted(found.join(terms.distinct(), "keyword").collect()) == sorted(every.join(terms.distinct(), "keyword").collect())
    assert found.count() == (2 if named == 100 else every.count())
