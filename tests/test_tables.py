import pytest
from pyspark.sql import functions as F

from docloom.operators import tables

TABLE = "array<array<string>>"


def value(spark, table, expression):
    return spark.createDataFrame([(table,)], f"t {TABLE}").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "header, kind",
    [
        (["Voyage", "Price of a berth", "Berths left"], "pricing"), (["Leg", "Day of travel", "Harbour"], "itinerary"),
        (["Engine", "Specification", "Unit"], "specifications"), (["House menu", "Feature", "Season"], "specifications"),
        (["Dish", "Course", "Note"], "menu"), (["Barrel", "Stock", "Cellar"], "inventory"),
        (["Left half", "Right half", "Rest"], "general"), (["Separate", "X", "Y"], "pricing"),
    ],
)
def test_table_type(spark, header, kind):
    assert value(spark, [header, ["a", "b", "c"]], tables.table_type) == kind


@pytest.mark.parametrize(
    "cell, kind", [("$ 12", "pricing"), ("€5", "pricing"), ("Day 3", "itinerary"), ("9:30 am", "itinerary"), ("12", "general")]
)
def test_table_type_from_content(spark, cell, kind):
    assert value(spark, [["A", "B"], ["x", "y"], [cell, ""]], tables.table_type) == kind
    assert value(spark, [["A", "B"], ["x", "y"], ["z", ""], [cell, ""]], tables.table_type) == "general"


def test_clean(spark):
    raw = [["  port", None, "tide "], [None, "low  \n water", "2 m"], ["Brest\t", "", " 7 m "]]
    assert value(spark, raw, tables.clean_rows) == [["port", "", "tide"], ["", "low water", "2 m"], ["Brest", "", "7 m"]]


def test_clean_drops_empty_rows(spark):
    raw = [["H1", "H2"], ["", ""], None, [None, None], ["a", "b"]]
    assert value(spark, raw, tables.clean_rows) == [["H1", "H2"], ["a", "b"]]
    assert len(value(spark, raw, lambda t: tables.clean_rows(t, drop_empty=False))) == 4


@pytest.mark.parametrize(
    "table, valid",
    [
        ([["a", "b"], ["c", "d"], ["e", "f"]], True), ([["a", "b"]], False), ([], False), (None, False),
        ([["a", "b"], ["c", ""], ["e", "f"]], True), ([["a", "", "", ""], ["", "", "", ""]], False), ([[], ["a"]], False),
    ],
)
def test_validity(spark, table, valid):
    assert value(spark, table, tables.is_valid) is valid


def test_plausible_and_width(spark):
    assert value(spark, [["", None], ["x", ""]], tables.is_plausible) is True
    assert value(spark, [["", None], ["", " "]], tables.is_plausible) is False
    assert value(spark, [["a"], ["a", "b"]], tables.has_even_width) is True
    assert value(spark, [["a"], ["a", "b"], ["a", "b", "c"]], tables.has_even_width) is False


def test_extraction_from_pages(spark):
    price = [["Cabin", "Price", "Deck"], ["A", "1", "x"], ["B", "2", "y"], ["C", "3", "z"]]
    days = [["Day", "Harbour", "Pilot"], ["1", "9", "x"], ["2", "10", "y"], ["3", "11", "z"]]
    pages = spark.createDataFrame(
        [("doc", "f.pdf", 1, "Page text " * 100, [[["only header"]], price]), ("doc", "f.pdf", 2, None, [days]), ("doc", "f.pdf", 3, "no", [])],
        f"doc_id string, source_file string, page_number long, text string, tables array<{TABLE}>",
    )
    found = {r["table_id"]: r for r in tables.extract_tables(pages).collect()}
    assert set(found) == {"tbl_doc_p1_1", "tbl_doc_p2_0"}
    first = found["tbl_doc_p1_1"]
    assert first["headers"] == price[0] and first["rows"] == price[1:] and len(first["context"]) == 500
    assert (first["row_count"], first["column_count"], first["confidence"]) == (4, 3, 0.8999999999999999)
    assert found["tbl_doc_p2_0"]["context"] == ""
    counts = {r["table_type"]: r["tables"] for r in tables.count_by_type(tables.extract_tables(pages)).collect()}
    assert counts == {"pricing": 1, "itinerary": 1}


def test_confidence_of_small_general_table(spark):
    assert value(spark, [["a"], ["b"]], lambda t: tables.confidence(t, F.lit("general"))) == 0.5


def test_tables_are_cleaned_once(spark):
    raw = [None, [["Dish ", "Price"], None, ["a  b", None], [" ", ""]], [["x", ""]]]
    pages = spark.createDataFrame([("d1", "a/f.pdf", 3, "T", raw), ("d2", "g.pdf", 1, None, None)],
        f"doc_id string, source_file string, page_number long, text string, tables array<{TABLE}>")
    found = tables.extract_tables(pages)
    assert [(r["table_id"], r["headers"], r["rows"]) for r in found.collect()] == [("tbl_d1_p3_1", ["Dish", "Price"], [["a b", ""]])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
