import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, prompts

BURGER = {"description": "A burger", "category": "food", "tags": ["a", "b", "c"], "is_product": True, "confidence": 0.95}


def analysis(spark, response):
    df = spark.createDataFrame([("i", response)], "image_id string, response string")
    return answers.parse_analysis(df).first()["analysis"]


def test_plain_json(spark):
    got = analysis(spark, json.dumps(BURGER))
    assert (got["description"], got["category"], got["tags"], got["confidence"]) == ("A burger", "food", ["a", "b", "c"], 0.95)


def test_json_in_prose(spark):
    got = analysis(spark, 'Sure: {"description": "x", "category": "product"} as asked.')
    assert got["category"] == "product"


@pytest.mark.parametrize("response", ["no object in these words", '{"a": 1} and {"b": 2}', '{"open": '])
def test_unreadable_answer(spark, response):
    got = analysis(spark, response)
    assert (got["description"], got["category"], got["confidence"]) == (response, "other", 0.5)


@pytest.mark.parametrize(
    "raw, category",
    [("product", "product"), (" Food ", "food"), ("SERVICE", "service"), ("unknown", "other"), ("other", "other"), (None, "other"),
     ("destination", "destination"), ("person", "person"), ("document", "document"), ("logo", "logo")],
)
def test_categories(spark, raw, category):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(answers.image_category(F.col("c"))).first()[0] == category


def test_failed_and_missing_answers(spark):
    images = spark.createDataFrame([("ok",), ("bad",), ("none",)], "image_id string")
    given = spark.createDataFrame(
        [("ok", '{"description": "x"}', None), ("bad", None, "timeout")], "image_id string, response string, error string"
    )
    got = {r["image_id"]: r for r in answers.analyses(images, given).collect()}
    assert got["ok"]["confidence"] == 0.85 and got["ok"]["category"] == "other"
    assert got["bad"]["confidence"] == 0.0 and "timeout" in got["bad"]["description"]
    assert got["none"]["confidence"] == 0.0 and got["none"]["tags"] == []


@pytest.mark.parametrize(
    "response, name",
    [
        ('{"name": "x"}', "x"), ('```json\n{"name": "x"}\n```', "x"), ('```\n[1, {"name": "x"}, {"name": "y"}]\n```', "x"),
        ('Text ```{"name": "x"}``` ```{"name": "y"}```', "x"), ("", None), (None, None), ("[]", None), ("5", None), ("{broken", None),
        ('{"name": "x"} trailing', None),
    ],
)
def test_fenced_answers(spark, response, name):
    df = spark.createDataFrame([(response,)], "response string")
    got = answers.parse_fenced(df).select(F.try_variant_get("data", "$.name", "string")).first()[0]
    assert got == name


def test_service_defaults(spark):
    rows = [
        ("1", "City Tour.pdf", '{"price": 120.5, "category": "Trek", "policies": {"cancellation": "none"}}'),
        ("2", "plain.docx", "no json"),
        ("3", "free.pdf", '{"name": "Free", "price": 0, "currency": "EUR"}'),
    ]
    df = spark.createDataFrame(rows, "doc_id string, doc_name string, response string")
    got = {r["doc_id"]: r for r in answers.services(answers.parse_fenced(df)).collect()}
    first = got["1"]
    assert (first["service_id"], first["name"], first["tags"]) == ("svc_city_tour.pdf", "City Tour", ["trek"])
    assert (first["base_price"], first["currency"], first["price_type"]) == (120.5, "INR", "per unit")
    assert first["cancellation_policy"] == "none" and first["description"] == "Business offering - City Tour.pdf"
    assert (got["2"]["name"], got["2"]["category"], got["2"]["tags"]) == ("plain", "General", ["business"])
    assert got["3"]["base_price"] is None and got["3"]["currency"] is None


def test_image_prompt(spark):
    df = spark.createDataFrame([("c" * 600, "embedded_pdf"), (None, "standalone")], "c string, m string")
    got = [r[0] for r in df.select(prompts.image_prompt(F.col("c"), F.col("m"), "P")).collect()]
    assert got[0].count("c") >= 500 and "P\n\nNote: This image was embedded in a business document." in got[0]
    assert got[1] == "P"


def test_business_type_and_company_text(spark):
    docs = spark.createDataFrame([("j", "a", 1), ("j", "b", 2), ("k", "c", 1), ("l", "d", 1)], "job_id string, doc_id string, doc_order int")
    pages = spark.createDataFrame(
        [("a", "a.pdf", 1, "We sell"), ("b", "b.pdf", 1, "mountain HIKES"), ("c", "c.pdf", 2, "an item"), ("c", "c.pdf", 1, " ")],
        "doc_id string, source_file string, page_number long, text string",
    )
    kinds = {r["job_id"]: r["business_type"] for r in prompts.business_type(docs, pages).collect()}
    assert kinds == {"j": "service", "k": "product", "l": "service"}
    inputs = {r["job_id"]: r["input"] for r in prompts.company_requests(docs, pages).collect()}
    assert inputs["j"] == "[Page 1]\nWe sell[Page 1]\nmountain HIKES" and inputs["k"] == "[Page 2]\nan item"


def test_service_parts_and_company_info(spark):
    rows = [
        (1, "a.pdf", '{"details": {"seats": 4, "age": "8+"}, "inclusions": ["lunch"], "faqs": [{"question": "Q", "answer": "A"}], "email": "a@b.c"}'),
        (2, "b.pdf", '{"details": "none", "inclusions": null, "faqs": 3, "name": "B"}'),
        (3, "c.pdf", "nothing"),
    ]
    parsed = answers.parse_fenced(spark.createDataFrame(rows, "doc_id long, doc_name string, response string"))
    got = {r["doc_id"]: r for r in answers.services(parsed).collect()}
    assert got[1]["details"] == {"seats": "4", "age": "8+"} and got[1]["inclusions"] == ["lunch"] and got[1]["exclusions"] == []
    assert [tuple(f) for f in got[1]["faqs"]] == [("Q", "A")]
    assert all(got[i][c] in ({}, []) for i in (2, 3) for c in ("details", "inclusions", "exclusions", "faqs"))
    company = {r["doc_id"]: r for r in answers.company_info(parsed).collect()}
    assert company[1]["email"] == "a@b.c" and company[2]["name"] == "B" and company[3]["name"] is None


def test_an_answer_is_parsed_once(spark):
    """Neither the checks of a value's kind nor the filter on names parse an answer again."""
    rows = [(1, "A.pdf", '[1, {"name": "x"}]'), (2, "", "{}"), (3, "B.pdf", "{}"), (4, "", None), (5, "C.pdf", "{broken")]
    given = spark.createDataFrame(rows, "doc_id long, doc_name string, response string")
    offered = answers.services(answers.parse_fenced(given))
    assert sorted((r["doc_id"], r["name"]) for r in offered.collect()) == [(1, "x"), (3, "B"), (5, "C")]
    plan = offered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson(") == 1
    assert answers.parse_analysis(given.select("response")).count() == 5
