import pytest
from pyspark.sql import functions as F

from docloom.operators import profiles
from docloom.operators.numbering import number_rows

SERVICES = "profile_id long, ordinal long, service_id string, name string"


@pytest.fixture(scope="module")
def services(spark):
    rows = [(1, i, f"svc_{i}", f"a{i}") for i in range(4)] + [(2, 0, "svc_0", "b0")]
    return spark.createDataFrame(rows, SERVICES)


def listing(df):
    return sorted((r["profile_id"], r["ordinal"], r["service_id"], r["name"]) for r in df.collect())


@pytest.mark.parametrize("width", [1, 3, 100_000])
def test_numbering_is_dense_across_blocks(spark, width):
    rows = [(g, o) for g in "ab" for o in (5, 0, 17, 3, 900, 18)]
    got = number_rows(spark.createDataFrame(rows, "g string, o long"), ["g"], "o", "n", width).collect()
    for g in "ab":
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])] == list(range(6))


def test_upsert_counts_versions(spark):
    base = spark.createDataFrame([("a", "x", 1, "t0"), ("b", "y", 4, "t0")], "job_id string, name string, version int, saved_at string")
    updates = spark.createDataFrame([("b", None), ("c", "z")], "job_id string, name string")
    got = {r["job_id"]: tuple(r)[1:] for r in profiles.upsert(base, updates, F.lit("t1")).collect()}
    assert got == {"a": ("x", 1, "t0"), "b": (None, 5, "t1"), "c": ("z", 1, "t1")}
    assert [r["job_id"] for r in profiles.delete(base, updates).collect()] == ["a"]


def test_replace_ignores_positions_outside(spark, services):
    changes = spark.createDataFrame([(1, 2, "svc_2", None), (1, 9, "svc_9", "new")], SERVICES)
    got = listing(profiles.replace_services(services, changes).fillna("-", ["name"]))
    assert got == [(1, 0, "svc_0", "a0"), (1, 1, "svc_1", "a1"), (1, 2, "svc_2", "-"), (1, 3, "svc_3", "a3"), (2, 0, "svc_0", "b0")]


def test_append_continues_the_count(spark, services):
    added = spark.createDataFrame([(1, 20, "n2"), (1, 10, "n1"), (3, 5, "c0")], "profile_id long, at long, name string")
    got = listing(profiles.append_services(services, added, "at"))
    assert (1, 4, "svc_4", "n1") in got and (1, 5, "svc_5", "n2") in got and (3, 0, "svc_0", "c0") in got and len(got) == 8


def test_delete_closes_gaps(spark, services):
    removed = spark.createDataFrame([(1, 0), (1, 2), (2, 7)], "profile_id long, ordinal long")
    assert listing(profiles.delete_services(services, removed)) == [(1, 0, "svc_0", "a1"), (1, 1, "svc_1", "a3"), (2, 0, "svc_0", "b0")]


def test_list_newest_first(spark, services):
    saved = spark.createDataFrame(
        [(1, "j1", "service", ("N",), "2024-01-01"), (2, "j2", None, (None,), "2024-01-03")],
        "profile_id long, job_id string, business_type string, business_info struct<name:string>, saved_at string",
    )
    got = profiles.list_profiles(saved, services, services.limit(0)).collect()
    assert [(r["job_id"], r["business_name"], r["business_type"], r["services_count"], r["products_count"]) for r in got] == [
        ("j2", "Unknown", "unknown", 1, 0), ("j1", "N", "service", 4, 0),
    ]


def test_flatten(spark):
    df = spark.createDataFrame([({"name": "top", "grade": "", "note": ""}, {"name": "inner", "grade": "easy", "days": "3", "x": None})],
                               "i map<string,string>, d map<string,string>")
    got = df.select(profiles.flatten_item(F.col("i"), F.col("d"))).first()[0]
    assert got == {"name": "top", "grade": "easy", "note": "", "days": "3"}
    assert df.select(profiles.flatten_item(F.col("i"), F.lit(None).cast("map<string,string>"))).first()[0]["grade"] == ""


@pytest.mark.parametrize("key, label", [("payment_policy", "Payment Policy"), ("travelInfo", "Travel Info"), ("a-b_cD", "A B C D"), ("URL", "URL"), ("x (y)", "X (Y)")])
def test_humanize(spark, key, label):
    assert spark.createDataFrame([(key,)], "k string").select(profiles.humanize(F.col("k"))).first()[0] == label


@pytest.mark.parametrize("price, currency, label", [(1234567.0, None, "₹1,234,567"), (1234.5, "USD ", "USD 1,234.5"), (0.0, "$", None), (None, "$", None), (12.3456, "$", "$12.346")])
def test_price_label(spark, price, currency, label):
    df = spark.createDataFrame([(price, currency)], "p double, c string")
    assert df.select(profiles.price_label(F.col("p"), F.col("c"))).first()[0] == label


def test_small_item_views(spark):
    df = spark.createDataFrame([({"refund_terms": "x", "warranty": "", "name": "y", "_m": "z"},)], "i map<string,string>")
    item = F.col("i")
    assert df.select(profiles.policy_fields(item)).first()[0] == {"refund_terms": "x"}
    assert df.select(profiles.first_key(item, ["title", "warranty", "name"])).first()[0] == "warranty"
    assert "_m" not in df.select(profiles.export_json(item)).first()[0]
    lists = spark.createDataFrame([(1, ["a"], [], ["q1", "q2"])], "id int, tags array<string>, inclusions array<string>, faqs array<string>")
    assert [r["label"] for r in profiles.badges(lists, ["tags", "inclusions", "faqs"], ["id"]).collect()] == ["Tags (1)", "FAQ (2)"]


def test_migration(spark):
    df = spark.createDataFrame([("a", "1.0"), ("b", "1.1"), ("c", "0.1")], "job_id string, schema_version string")
    done, rejected = profiles.migrate(df, "1.1", {"1.0->1.1": {"currency": F.lit("INR")}, "1.1->1.2": {"other": F.lit(1)}})
    assert {tuple(r) for r in done.collect()} == {("a", "1.1", "INR"), ("b", "1.1", None)}
    assert rejected.first()["error"] == "No migration path from 0.1 to 1.1"


def test_profile_parts_hold_all_services(spark):
    people = spark.createDataFrame([(1, "j", "service", ("N",)), (2, "k", "product", ("M",))],
                                   "profile_id long, job_id string, business_type string, business_info struct<name:string>")
    many = spark.createDataFrame([(1, i, f"svc_{i}", "n") for i in range(25)], SERVICES)
    docs = spark.createDataFrame([("j", 3)], "job_id string, documents long")
    got = profiles.profile_parts(people, many, docs, part_rows=10).orderBy("profile_id", "part").collect()
    assert [len(r["services"] or []) for r in got] == [10, 10, 5, 0]
    assert [s["ordinal"] for r in got[:3] for s in r["services"]] == list(range(25))
    assert (got[0]["llm_calls"], got[3]["llm_calls"]) == (5, 2)


def test_edits_of_one_key_apply_in_order(spark):
    base = spark.createDataFrame([("a", "old", 3, "t0"), ("b", "kept", 1, "t0")], "job_id string, name string, version int, saved_at string")
    edits = spark.createDataFrame([("a", "last", 2), ("a", "first", 1), ("c", "new", 1)], "job_id string, name string, at int")
    rows = sorted(map(tuple, profiles.upsert(base, edits, F.lit("t1"), "at").collect()))
    assert rows == [("a", "last", 5, "t1"), ("b", "kept", 1, "t0"), ("c", "new", 1, "t1")]
    services = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "profile_id long, ordinal long, name string")
    changes = spark.createDataFrame([(1, 0, "second", 2), (1, 0, "first", 1), (9, 0, "none", 1)], "profile_id long, ordinal long, name string, at int")
    replaced = profiles.replace_services(services, changes, "at").collect()
    assert sorted(map(tuple, replaced)) == [(1, 0, "second"), (1, 1, "y")]
