import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.operators import validation

SCHEMA = (
    "profile_id long, job_id string, business_type string, business_info struct<name:string,description:string,category:string,"
    "location:struct<address:string,city:string,state:string,country:string>,"
    "contact:struct<phone:string,email:string,website:string>,"
    "working_hours:struct<monday:string,tuesday:string,wednesday:string,thursday:string,friday:string,saturday:string,sunday:string>>"
)
SERVICES = (
    "profile_id long, ordinal long, name string, description string, category string, base_price double, discount_price double,"
    " details map<string,string>, itinerary array<string>, inclusions array<string>, exclusions array<string>,"
    " cancellation_policy string, payment_policy string, travel_info string, faqs array<string>, tags array<string>"
)
PRODUCTS = (
    "profile_id long, ordinal long, name string, description string, base_price double, discount_price double,"
    " specifications map<string,string>"
)
FULL_CONTACT = ("+1 555 123 4567", "a@b.com", "https://x.com")
FULL_PLACE = ("Street 1", "City", None, "Land")
HOURS = ("9-17", None, None, None, None, None, None)
TEXT = "A long enough description"


def profile(spark, kind="service", name="N", text=TEXT, place=FULL_PLACE, contact=FULL_CONTACT, hours=HOURS, info=True):
    business = (name, text, "cat", place, contact, hours) if info else None
    return spark.createDataFrame([(1, "job_1", kind, business)], SCHEMA)


def service(spark, **changes):
    full = dict(
        profile_id=1, ordinal=0, name="S", description=TEXT, category="c", base_price=10.0, discount_price=None,
        details={"duration": "3 days"}, itinerary=["d1"], inclusions=["i"], exclusions=["e"], cancellation_policy="c",
        payment_policy="p", travel_info="t", faqs=["f"], tags=["a", "b"],
    )
    full.update(changes)
    return spark.createDataFrame([Row(**full)], SERVICES)


def product(spark, **changes):
    full = dict(profile_id=1, ordinal=0, name="P", description="d", base_price=5.0, discount_price=None, specifications={"a": "b"})
    full.update(changes)
    return spark.createDataFrame([Row(**full)], PRODUCTS)


def none(spark, schema):
    return spark.createDataFrame([], schema)


def result(spark, profiles, products=None, services=None):
    jobs = spark.createDataFrame([("job_1",)], "job_id string")
    products = products if products is not None else none(spark, PRODUCTS)
    services = services if services is not None else none(spark, SERVICES)
    return validation.validate(jobs, profiles, products, services).first()


def test_complete_service_profile(spark):
    got = result(spark, profile(spark), services=service(spark))
    assert (got["is_valid"], got["errors"], got["warnings"]) == (True, 0, 0)
    assert got["completeness"] == pytest.approx(0.7)


def test_info_score_without_contact_and_place(spark):
    df = profile(spark, place=None, contact=None)
    assert df.select(validation.info_score()).first()[0] == pytest.approx(0.6)
    assert profile(spark).select(validation.info_score()).first()[0] == 1.0
    assert profile(spark, info=False).select(validation.info_score()).first()[0] == 0.0


def test_bad_contact_values(spark):
    got = result(spark, profile(spark, contact=("555 12 3", "bad", "www.x.com")), services=service(spark))
    assert (got["is_valid"], got["errors"], got["warnings"]) == (False, 1, 2)
    good = result(spark, profile(spark, contact=("555 12 3", None, "www.x.com")), services=service(spark))
    assert (good["is_valid"], good["errors"], good["warnings"]) == (True, 0, 2)


@pytest.mark.parametrize("value, ok", [("a@b.co", True), ("a@b", False), ("a b@c.de", False), ("@c.de", False), ("a.b+c@d-e.org", True)])
def test_email(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(validation.is_email(F.col("v"))).first()[0] is ok


@pytest.mark.parametrize(
    "base, discount, found",
    [(-1.0, None, ["error"]), (1000001.0, None, ["warning"]), (10.0, 11.0, ["error"]), (0.0, 5.0, []), (None, 5.0, []), (10.0, -1.0, ["error"]),
     (-2.0, -1.0, ["error", "error"]), (None, None, [])],
)
def test_prices(spark, base, discount, found):
    rows = validation.price_findings(service(spark, base_price=base, discount_price=discount), "services").collect()
    assert [r["severity"] for r in rows] == found


def test_high_price_message(spark):
    message = validation.price_findings(product(spark, base_price=12345678.5), "products").first()
    assert message["message"] == "Base price seems very high: 12345678.5"
    assert message["field"] == "products[0].pricing.base_price"


def test_missing_parts(spark):
    empty = (None, None, None, None)
    rows = validation.findings(
        profile(spark, kind="mixed", name="", text="short", place=empty, hours=(None,) * 7), none(spark, PRODUCTS), none(spark, SERVICES)
    ).collect()
    assert {(r["field"], r["error_type"]) for r in rows} == {
        ("business_info.name", "missing"), ("business_info.description", "too_short"), ("business_info.location", "incomplete"),
        ("business_info.working_hours", "missing"), ("products", "missing"), ("services", "missing"),
    }


def test_missing_info_and_profile(spark):
    got = result(spark, profile(spark, info=False), services=service(spark))
    assert (got["errors"], got["is_valid"]) == (1, False)
    nothing = result(spark, none(spark, SCHEMA))
    assert (nothing["errors"], nothing["warnings"], nothing["completeness"], nothing["is_valid"]) == (1, 0, 0.0, False)
    jobs = spark.createDataFrame([("job_1",), ("job_2",)], "job_id string")
    assert [r["job_id"] for r in validation.missing_profiles(jobs, profile(spark)).collect()] == ["job_2"]


def test_items_count_only_for_their_business_type(spark):
    bad = product(spark, name="", base_price=-1.0)
    assert result(spark, profile(spark, kind="service"), products=bad, services=service(spark))["errors"] == 0
    assert result(spark, profile(spark, kind="mixed"), products=bad, services=service(spark))["errors"] == 1


def test_product_and_service_scores(spark):
    assert product(spark).select(validation.product_score()).first()[0] == pytest.approx(1.0)
    assert product(spark, specifications={}, base_price=0.0).select(validation.product_score()).first()[0] == pytest.approx(0.5)
    assert service(spark, details={}, itinerary=None).select(validation.service_score()).first()[0] == 0.75


def test_editor_scale(spark):
    full = validation.editor_completeness(profile(spark), service(spark)).first()
    assert (full["business_info"], full["services"]) == (1.0, 1.0) and full["overall"] == pytest.approx(1.0)
    part = service(spark, tags=["one"], description="x" * 20, details={"a": "b"})
    assert validation.editor_completeness(profile(spark), part).first()["services"] == pytest.approx(10 / 13)
    assert validation.editor_completeness(profile(spark), none(spark, SERVICES)).first()["services"] == 0.0
    fill = validation.service_fill(part).first()
    assert (fill["filled"], fill["percent"]) == (13, 100)
    assert validation.service_fill(service(spark, faqs=[], name=None)).first()["percent"] == 84


def test_exclusive_types_and_ranges(spark):
    both = validation.exclusive_findings(profile(spark, kind="service"), product(spark), service(spark)).collect()
    assert [r["message"] for r in both] == ["Service-only business cannot have products"]
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 1.1), ("d", -0.1), ("e", None)], "k string, v double")
    assert {r["row_key"] for r in validation.out_of_range(df, "k", "v", 0, 1).collect()} == {"c", "d"}
    assert {r["row_key"] for r in validation.out_of_range(df, "k", "v", low=0, open_low=True).collect()} == {"a", "d"}


def test_field_score_rows(spark):
    rows = {r["field_group"]: r for r in validation.field_score_rows(profile(spark)).collect()}
    assert (rows["location"]["populated_fields"], rows["location"]["total_fields"], rows["location"]["score"]) == (3, 4, 0.75)
