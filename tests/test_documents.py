import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import documents

PAGES = "doc_id string, source_file string, page_number long, text string"


@pytest.fixture(scope="module")
def long_document(spark):
    return spark.createDataFrame([("d", "d.pdf", n, "x" if n % 3 else " \n ") for n in range(1, 2501)], PAGES)


def whole(rows):
    return "\n\n".join(f"[Page {r['page_number']}]\n{r['text']}" for r in rows if r["text"].strip())


def test_full_text_in_parts_is_whole(long_document):
    rows = long_document.orderBy("page_number").collect()
    parts = documents.full_text(long_document).orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1, 2]
    assert "\n\n".join(r["text"] for r in parts) == whole(rows)


@pytest.mark.parametrize("chars_per_part", [1, 40, 100_000])
def test_parts_are_bounded_by_characters(spark, long_document, chars_per_part):
    short = spark.createDataFrame([("e", "e.pdf", 1, "ab"), ("e", "e.pdf", 2, "c" * 300)], PAGES)
    both = long_document.filter("page_number <= 60").unionByName(short)
    parts = documents.full_text(both, 50, chars_per_part).orderBy("doc_id", "part").collect()
    for doc in "de":
        rows = both.filter(f"doc_id = '{doc}'").orderBy("page_number").collect()
        own = [r for r in parts if r["doc_id"] == doc]
        assert [r["part"] for r in own] == list(range(len(own)))
        assert "\n\n".join(r["text"] for r in own) == whole(rows)
        assert max(len(r["text"]) for r in own) <= 2 * chars_per_part + 330
    assert len(parts) == {1: 42, 40: len(parts), 100_000: 3}[chars_per_part]


@pytest.mark.parametrize("chars", [5, 100, 7000])
def test_text_start_is_a_prefix_of_the_full_text(long_document, chars):
    expected = whole(long_document.orderBy("page_number").collect())[:chars]
    assert documents.text_start(long_document, chars).first()["text"] == expected


def test_text_length(spark, long_document):
    odd = spark.createDataFrame([("e", "e.pdf", 1, "  ab "), ("e", "e.pdf", 2, "cd \n\t "), ("e", "e.pdf", 3, " ")], PAGES)
    both = long_document.unionByName(odd)
    got = {r["doc_id"]: r["chars"] for r in documents.text_chars(both).collect()}
    for doc, chars in got.items():
        assert chars == len(whole(both.filter(F.col("doc_id") == doc).orderBy("page_number").collect()).strip())


def test_service_candidates(spark):
    text = "x" * 90
    df = spark.createDataFrame(
        [("a", "p/a.pdf", 1, text + "x"), ("b", "p/b.PDF", 1, text * 2), ("c", "p/c.docx", 1, text), ("d", "p/d.docx", 1, text * 2)], PAGES
    )
    assert {r["doc_name"] for r in documents.service_candidates(df).collect()} == {"a.pdf", "d.docx"}


@pytest.mark.parametrize(
    "value, expected",
    [("D:20240131235959+05'30'", datetime.datetime(2024, 1, 31, 23, 59, 59)), ("20240131235959", datetime.datetime(2024, 1, 31, 23, 59, 59)),
     ("D:20240231000000", None), ("junk", None), (None, None), ("D:20240131235959-0800", datetime.datetime(2024, 1, 31, 23, 59, 59))],
)
def test_pdf_dates(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    got = df.select(F.date_format(documents.pdf_date(F.col("v")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == (expected and expected.strftime("%Y-%m-%d %H:%M:%S"))


def test_empty_input(spark):
    empty = spark.createDataFrame([], PAGES)
    assert documents.full_text(empty).count() == 0 and documents.service_candidates(empty).count() == 0
