"""Reading the answers of a batch language or vision model. Input: a response text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import text as tx
from docloom.functions.lookup import bound, has_number, has_text

ANALYSIS_SCHEMA = (
    "description string, category string, tags array<string>, is_product boolean,"
    " is_service_related boolean, associations array<string>, confidence double"
)
FENCE = "```"
FAQS = "array<struct<question:string,answer:string>>"


def fenced_json(response: Column) -> Column:
    """The JSON text between the first pair of fences (or all of it), without the language tag."""
    inside = F.get(F.split(response, FENCE), F.lit(1))
    untagged = F.when(F.startswith(inside, F.lit("json")), F.substring(inside, 5, 1 << 30)).otherwise(inside)
    body = F.when(F.contains(response, F.lit(FENCE)), untagged).otherwise(response)
    return tx.strip(tx.or_empty(body))


def strict_json(text: Column) -> Column:
    """The text as one VARIANT value; null when it is not JSON or anything follows the value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.try_variant_get(wrapped, "$", "array<variant>")
    return bound(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def first_object(json_text: Column) -> Column:
    """The JSON object as VARIANT: a list gives its first object, anything else null."""
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    first = lambda v: F.when(is_object(v), v).otherwise(F.get(F.filter(items(v), is_object), F.lit(0)))
    return bound(strict_json(json_text), first)


def parse_fenced(responses: DataFrame) -> DataFrame:
    """Adds `data`, the answer object; null stands for an empty one."""
    return responses.withColumn("data", first_object(fenced_json(F.col("response"))))


def _text_field(path: str) -> Column:
    return F.try_variant_get("data", path, "string")


def services(parsed: DataFrame) -> DataFrame:
    """Service rows with defaults from parsed answers. Input: doc_id, doc_name, data.

    Rows without a name are left out of a list of one: a plain filter would be moved below and parse each answer again.
    """

    def or_else(path: str, default: Column) -> Column:
        value = _text_field(path)
        return F.when(has_text(value), value).otherwise(default)

    def or_empty(path: str, kind: str, empty: Column) -> Column:
        """Missing parts, and parts of another shape, are empty."""
        return F.coalesce(F.try_variant_get("data", path, kind), empty)

    price = F.try_variant_get("data", "$.price", "double")
    priced = has_number(price)
    name = F.replace(F.replace("doc_name", F.lit(".pdf"), F.lit("")), F.lit(".docx"), F.lit(""))
    service_id = F.lower(F.replace(F.substring("doc_name", 1, 20), F.lit(" "), F.lit("_")))
    rows = parsed.select(
        "doc_id",
        F.concat(F.lit("svc_"), service_id).alias("service_id"),
        or_else("$.name", name).alias("name"),
        or_else("$.description", F.concat(F.lit("Business offering - "), "doc_name")).alias("description"),
        or_else("$.category", F.lit("General")).alias("category"),
        F.when(priced, price).alias("base_price"),
        F.when(priced, F.coalesce(_text_field("$.currency"), F.lit("INR"))).alias("currency"),
        F.when(priced, F.lit("per unit")).alias("price_type"),
        or_empty("$.details", "map<string,string>", F.create_map().cast("map<string,string>")).alias("details"),
        or_empty("$.inclusions", "array<string>", tx.no_strings()).alias("inclusions"),
        or_empty("$.exclusions", "array<string>", tx.no_strings()).alias("exclusions"),
        _text_field("$.policies.cancellation").alias("cancellation_policy"),
        or_empty("$.faqs", FAQS, F.array().cast(FAQS)).alias("faqs"),
        F.array(F.lower(F.coalesce(_text_field("$.category"), F.lit("business")))).alias("tags"),
    )
    named = F.filter(F.array(F.struct(*rows.columns)), lambda r: has_text(r["name"]))
    return rows.select(F.inline(named))


def company_info(parsed: DataFrame) -> DataFrame:
    """Name, description, category and contact of a company; all null where the answer is no object.

    Input: key columns and data, from `parse_fenced`.
    """
    fields = ("name", "description", "category", "email", "phone", "website")
    kept = [c for c in parsed.columns if c not in ("data", "response", *fields)]
    return parsed.select(*kept, *[_text_field(f"$.{f}").alias(f) for f in fields])


def named_services(rows: DataFrame) -> DataFrame:
    return rows.filter(has_text(F.col("name")))


def parse_analysis(responses: DataFrame) -> DataFrame:
    """Adds `analysis` from the text between the first and the last brace.

    An unreadable answer becomes a record of its first 500 characters with confidence 0.5.
    """
    outer = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    body = F.when(outer != "", outer).otherwise(F.col("response"))
    readable = strict_json(body).isNotNull()
    fallback = F.struct(
        F.substring("response", 1, 500).alias("description"),
        F.lit("other").alias("category"),
        tx.no_strings().alias("tags"),
        F.lit(False).alias("is_product"),
        F.lit(False).alias("is_service_related"),
        tx.no_strings().alias("associations"),
        F.lit(0.5).alias("confidence"),
    )
    return responses.withColumn("analysis", F.when(readable, F.from_json(body, ANALYSIS_SCHEMA)).otherwise(fallback))


def image_category(value: Column) -> Column:
    """One of the known categories, otherwise other."""
    name = tx.strip(F.lower(value))
    return F.when(name.isin(fv.IMAGE_CATEGORIES), name).otherwise("other")


def analyses(images: DataFrame, responses: DataFrame) -> DataFrame:
    """One analysis per image; failed or missing answers give a record with confidence 0."""
    given = responses.select("image_id", "response", "error")
    joined = parse_analysis(images.select("image_id").join(given, "image_id", "left"))
    missing = F.col("error").isNotNull() | F.col("response").isNull() | F.col("analysis").isNull()
    why = F.coalesce("error", F.lit("no response"))
    a = F.col("analysis")
    return joined.select(
        "image_id",
        F.when(missing, F.concat(F.lit("Vision analysis unavailable: "), why)).otherwise(
            tx.or_empty(a["description"])
        ).alias("description"),
        image_category(F.when(~missing, a["category"])).alias("category"),
        F.coalesce(F.when(~missing, a["tags"]), tx.no_strings()).alias("tags"),
        F.coalesce(~missing & a["is_product"], F.lit(False)).alias("is_product"),
        F.coalesce(~missing & a["is_service_related"], F.lit(False)).alias("is_service_related"),
        F.coalesce(F.when(~missing, a["associations"]), tx.no_strings()).alias("suggested_associations"),
        F.when(missing, F.lit(0.0)).otherwise(F.coalesce(a["confidence"], F.lit(0.85))).alias("confidence"),
    )
