"""Checks and completeness scores of business profiles.

Input profiles: profile_id, job_id, business_type, business_info (struct with name,
description, category, location, contact, working_hours). Children are rows:
services and products with profile_id and ordinal. Checks are columns on each row;
scores of children are averaged with partial aggregation, so a profile may own any
share of all children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.lookup import has_items, has_number, has_text


def is_email(value: Column) -> Column:
    return value.rlike(fv.EMAIL_ADDRESS)


def is_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"\D", "")) >= fv.MIN_PHONE_DIGITS


def is_web_address(value: Column) -> Column:
    return value.rlike(fv.WEB_ADDRESS)


def _finding(when: Column, field, kind: str, message, severity: str) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        when,
        F.struct(
            as_column(field).alias("field"),
            F.lit(kind).alias("error_type"),
            as_column(message).alias("message"),
            F.lit(severity).alias("severity"),
        ),
    )


def _rows(df: DataFrame, findings: list[Column]) -> DataFrame:
    present = F.filter(F.array(*findings), lambda f: f.isNotNull())
    return df.select("profile_id", F.inline(present))


def _info(path: str = "") -> Column:
    return F.col("business_info" + path)


def contact_checks() -> list[Column]:
    email, phone, web = (_info(f".contact.{n}") for n in ("email", "phone", "website"))
    at = "business_info.contact."
    return [
        _finding(has_text(email) & ~is_email(email), at + "email", "invalid_format",
                 F.concat(F.lit("Invalid email format: "), email), "error"),
        _finding(has_text(phone) & ~is_phone(phone), at + "phone", "invalid_format",
                 F.concat(F.lit("Phone number format may be invalid: "), phone), "warning"),
        _finding(has_text(web) & ~is_web_address(web), at + "website", "invalid_format",
                 F.concat(F.lit("Website URL may be invalid: "), web), "warning"),
    ]


def info_checks() -> list[Column]:
    here = _info().isNotNull()
    name, text = _info(".name"), _info(".description")
    return [
        _finding(~here, "business_info", "missing", "Business information is missing", "error"),
        _finding(here & ~has_text(name), "business_info.name", "missing", "Business name not found", "warning"),
        _finding(here & ~has_text(text), "business_info.description", "missing",
                 "Business description not found", "warning"),
        _finding(has_text(text) & (F.length(text) < fv.MIN_DESCRIPTION_CHARS), "business_info.description",
                 "too_short", "Business description is too short (< 20 chars)", "warning"),
    ]


def location_checks() -> list[Column]:
    fields = [has_text(_info(f".location.{n}")) for n in ("address", "city", "state", "country")]
    none = ~(fields[0] | fields[1] | fields[2] | fields[3])
    return [
        _finding(_info(".location").isNotNull() & none, "business_info.location", "incomplete",
                 "Location has no address, city, state, or country", "warning")
    ]


def hours_checks() -> list[Column]:
    days = F.array(*[_info(f".working_hours.{d}") for d in fv.WEEKDAYS])
    return [
        _finding(_info(".working_hours").isNotNull() & ~F.exists(days, has_text), "business_info.working_hours",
                 "missing", "No working hours specified", "warning")
    ]


def contact_findings(profiles: DataFrame) -> DataFrame:
    return _rows(profiles, contact_checks())


def info_findings(profiles: DataFrame) -> DataFrame:
    return _rows(profiles, info_checks())


def location_findings(profiles: DataFrame) -> DataFrame:
    return _rows(profiles, location_checks())


def hours_findings(profiles: DataFrame) -> DataFrame:
    return _rows(profiles, hours_checks())


def _item(group: str, field: str) -> Column:
    return F.concat(F.lit(f"{group}["), "ordinal", F.lit(f"].{field}"))


def _plain_number(value: Column) -> Column:
    """A double as plain digits with at least one decimal, never in scientific notation."""
    return F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")


def price_checks(group: str) -> list[Column]:
    base, discount = F.col("base_price"), F.col("discount_price")
    base_field, discount_field = _item(group, "pricing.base_price"), _item(group, "pricing.discount_price")
    above = has_number(base) & (discount > base)
    return [
        _finding(base < 0, base_field, "invalid_value", "Base price cannot be negative", "error"),
        _finding(base > fv.HIGH_PRICE, base_field, "suspicious_value",
                 F.concat(F.lit("Base price seems very high: "), _plain_number(base)), "warning"),
        _finding(discount < 0, discount_field, "invalid_value", "Discount price cannot be negative", "error"),
        _finding((discount >= 0) & above, discount_field, "invalid_value",
                 "Discount price cannot be higher than base price", "error"),
    ]


def price_findings(items: DataFrame, group: str) -> DataFrame:
    return _rows(items, price_checks(group))


def _nth(label: str, what: str) -> Column:
    return F.concat(F.lit(label + " "), F.col("ordinal") + 1, F.lit(" has no " + what))


def product_checks() -> list[Column]:
    return [_finding(~has_text(F.col("name")), _item("products", "name"), "missing", _nth("Product", "name"), "warning")]


def service_checks() -> list[Column]:
    return [
        _finding(~has_text(F.col("name")), _item("services", "name"), "missing", _nth("Service", "name"), "warning"),
        _finding(~has_text(F.col("description")), _item("services", "description"), "missing",
                 _nth("Service", "description"), "warning"),
    ]


def product_findings(products: DataFrame) -> DataFrame:
    return _rows(products, product_checks())


def service_findings(services: DataFrame) -> DataFrame:
    return _rows(services, service_checks())


def missing_item_findings(profiles: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """Profiles whose type promises products or services they do not have."""

    def lacking(items: DataFrame, kind: str, group: str) -> DataFrame:
        bound = profiles.filter(F.col("business_type").isin(kind, "mixed")).select("profile_id")
        owners = items.select("profile_id").distinct()
        message = f"{kind.capitalize()} business has no {group}"
        return bound.join(owners, "profile_id", "left_anti").select(
            "profile_id",
            F.lit(group).alias("field"),
            F.lit("missing").alias("error_type"),
            F.lit(message).alias("message"),
            F.lit("warning").alias("severity"),
        )

    return lacking(products, "product", "products").unionByName(lacking(services, "service", "services"))


def exclusive_findings(profiles: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """Service-only profiles with products and product-only profiles with services."""

    def intruding(items: DataFrame, kind: str, group: str) -> DataFrame:
        bound = profiles.filter(F.col("business_type") == kind).select("profile_id")
        return bound.join(items.select("profile_id").distinct(), "profile_id", "left_semi").select(
            "profile_id",
            F.lit(group).alias("field"),
            F.lit(f"{kind.capitalize()}-only business cannot have {group}").alias("message"),
        )

    return intruding(products, "service", "products").unionByName(intruding(services, "product", "services"))


def findings(profiles: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """All findings. Products and services count only where the business type asks for them."""

    def checked(items: DataFrame, kind: str, checks: list[Column]) -> DataFrame:
        bound = profiles.filter(F.col("business_type").isin(kind, "mixed")).select("profile_id")
        found = items.select(
            "profile_id", F.filter(F.array(*checks), lambda f: f.isNotNull()).alias("found")
        ).filter(F.size("found") > 0)
        return found.join(bound, "profile_id", "left_semi").select("profile_id", F.inline("found"))

    own = _rows(profiles, info_checks() + contact_checks() + location_checks() + hours_checks())
    return (
        own.unionByName(checked(products, "product", product_checks() + price_checks("products")))
        .unionByName(checked(services, "service", service_checks() + price_checks("services")))
        .unionByName(missing_item_findings(profiles, products, services))
    )


def _points(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for present, points in parts:
        total = total + F.when(present, F.lit(points)).otherwise(F.lit(0.0))
    return total


def info_score() -> Column:
    points = _points(
        [
            (has_text(_info(".name")), 2.0),
            (has_text(_info(".description")), 1.0),
            (has_text(_info(".contact.email")), 0.5),
            (has_text(_info(".contact.phone")), 0.5),
            (has_text(_info(".location.city")), 0.5),
            (has_text(_info(".location.address")), 0.5),
        ]
    )
    return F.least(points / F.lit(5.0), F.lit(1.0))


def product_score() -> Column:
    return _points(
        [
            (has_text(F.col("name")), 0.3),
            (has_text(F.col("description")), 0.2),
            (has_number(F.col("base_price")), 0.3),
            (has_items(F.col("specifications")), 0.2),
        ]
    )


def service_score() -> Column:
    return _points(
        [
            (has_text(F.col("name")), 0.25),
            (has_text(F.col("description")), 0.25),
            (has_number(F.col("base_price")), 0.25),
            (has_items(F.col("details")) | has_items(F.col("itinerary")), 0.25),
        ]
    )


def mean_scores(items: DataFrame, score: Column, name: str) -> DataFrame:
    return items.groupBy("profile_id").agg(F.avg(score).alias(name))


def field_scores(profiles: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """profile_id with business_info, products and services scores; a missing group scores 0."""
    return (
        profiles.select("profile_id", "job_id", info_score().alias("business_info"))
        .join(mean_scores(products, product_score(), "products"), "profile_id", "left")
        .join(mean_scores(services, service_score(), "services"), "profile_id", "left")
        .fillna(0.0, ["products", "services"])
    )


def completeness(scores: DataFrame) -> DataFrame:
    """Adds the weighted completeness."""
    total = (
        F.col("business_info") * F.lit(0.4) + F.col("products") * F.lit(0.3) + F.col("services") * F.lit(0.3)
    )
    return scores.withColumn("completeness", F.least(total, F.lit(1.0)))


def field_score_map(scores: DataFrame) -> DataFrame:
    groups = ("business_info", "products", "services")
    pairs = [c for g in groups for c in (F.lit(g), F.col(g))]
    return scores.withColumn("field_scores", F.create_map(*pairs))


def validity(profiles: DataFrame, found: DataFrame) -> DataFrame:
    """errors, warnings and is_valid of each profile."""
    counts = found.groupBy("profile_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    joined = profiles.select("profile_id", "job_id").join(counts, "profile_id", "left").fillna(0, ["errors", "warnings"])
    return joined.withColumn("is_valid", F.col("errors") == 0)


def validate(jobs: DataFrame, profiles: DataFrame, products: DataFrame, services: DataFrame) -> DataFrame:
    """One result per job; a job without a profile has one error and scores 0."""
    results = validity(profiles, findings(profiles, products, services)).join(
        completeness(field_scores(profiles, products, services)).select("profile_id", "completeness"), "profile_id"
    )
    joined = jobs.select("job_id").join(results, "job_id", "left")
    return joined.select(
        "job_id",
        "profile_id",
        F.coalesce("is_valid", F.lit(False)).alias("is_valid"),
        F.coalesce("errors", F.lit(1)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        F.coalesce("completeness", F.lit(0.0)).alias("completeness"),
    )


def missing_profiles(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The finding for jobs without a profile."""
    return jobs.select("job_id").join(profiles.select("job_id"), "job_id", "left_anti").select(
        "job_id",
        F.lit("profile").alias("field"),
        F.lit("missing").alias("error_type"),
        F.lit("No profile to validate").alias("message"),
        F.lit("error").alias("severity"),
    )


def editor_info_score() -> Column:
    paths = [".name", ".description", ".category", ".contact.phone", ".contact.email", ".contact.website"]
    return _points([(has_text(_info(p)), 1.0) for p in paths]) / F.lit(6.0)


def editor_service_score() -> Column:
    long_text = has_text(F.col("description")) & (F.length("description") > 20)
    filled = [
        has_text(F.col("name")),
        long_text,
        has_text(F.col("category")),
        has_number(F.col("base_price")),
        has_text(F.try_element_at("details", F.lit("duration"))),
        has_items(F.col("itinerary")),
        has_items(F.col("inclusions")),
        has_items(F.col("exclusions")),
        has_text(F.col("cancellation_policy")),
        has_text(F.col("payment_policy")),
        has_text(F.col("travel_info")),
        has_items(F.col("faqs")),
        F.coalesce(F.size("tags") > 1, F.lit(False)),
    ]
    return _points([(f, 1.0) for f in filled]) / F.lit(13.0)


def editor_completeness(profiles: DataFrame, services: DataFrame) -> DataFrame:
    """The profile editor's own scale: information 0.3, mean of services 0.7."""
    joined = (
        profiles.select("profile_id", editor_info_score().alias("business_info"))
        .join(mean_scores(services, editor_service_score(), "services"), "profile_id", "left")
        .fillna(0.0, ["services"])
    )
    total = F.col("business_info") * F.lit(0.3) + F.col("services") * F.lit(0.7)
    return joined.withColumn("overall", total)


def editor_service_scores(services: DataFrame) -> DataFrame:
    """profile_id, ordinal, score: the editor's score of each service."""
    return services.select("profile_id", "ordinal", editor_service_score().alias("score"))


def filled_fields() -> Column:
    """How many of the thirteen service fields are filled."""
    flags = [
        has_text(F.col("name")), has_text(F.col("description")), has_text(F.col("category")),
        F.col("base_price").isNotNull() | F.col("discount_price").isNotNull(),
        has_items(F.col("details")), has_items(F.col("itinerary")), has_items(F.col("inclusions")),
        has_items(F.col("exclusions")), has_text(F.col("cancellation_policy")),
        has_text(F.col("payment_policy")), has_text(F.col("travel_info")), has_items(F.col("faqs")),
        has_items(F.col("tags")),
    ]
    return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))


def service_fill(services: DataFrame) -> DataFrame:
    """Filled fields and the whole percentage of each service."""
    filled = filled_fields()
    return services.select(
        "profile_id", "ordinal", filled.alias("filled"), F.floor(filled / F.lit(13) * F.lit(100)).alias("percent")
    )


def out_of_range(
    df: DataFrame, key: str, column: str, low: float | None = None, high: float | None = None, open_low: bool = False
) -> DataFrame:
    """Rows whose value breaks its declared range: key, column, value. Null is not checked."""
    value = F.col(column).cast("double")
    broken = F.lit(False)
    if low is not None:
        broken = broken | ((value <= low) if open_low else (value < low))
    if high is not None:
        broken = broken | (value > high)
    return df.filter(broken).select(
        F.col(key).cast("string").alias("row_key"), F.lit(column).alias("column_name"), value.alias("value")
    )


def range_findings(df: DataFrame, record: str, key: str) -> DataFrame:
    """record, row_key, column_name, value: the values outside their declared range, in one pass over the rows.

    record names the kind of rows, see FIELD_RANGES; df has its fields. NaN lies outside of every range that
    has an upper end, null is not checked.
    """
    found = []
    for field, low, high, open_low in fv.FIELD_RANGES[record]:
        value = F.col(field).cast("double")
        below = value <= F.lit(float(low)) if open_low else value < F.lit(float(low))
        broken = below if high is None else below | (value > F.lit(float(high)))
        found.append(F.when(broken, F.struct(F.lit(field).alias("column_name"), value.alias("value"))))
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.select(F.lit(record).alias("record"), "row_key", "column_name", "value")


def field_score_rows(profiles: DataFrame) -> DataFrame:
    """profile_id, field_group, total_fields, populated_fields, score: one row per group of fields."""
    groups = {
        "business_info": [".name", ".description", ".category"],
        "location": [".location.address", ".location.city", ".location.state", ".location.country"],
        "contact": [".contact.phone", ".contact.email", ".contact.website"],
    }
    entries = []
    for name, paths in groups.items():
        populated = sum((has_text(_info(p)).cast("int") for p in paths[1:]), has_text(_info(paths[0])).cast("int"))
        entries.append(
            F.struct(
                F.lit(name).alias("field_group"),
                F.lit(len(paths)).alias("total_fields"),
                populated.alias("populated_fields"),
                F.round(populated / F.lit(len(paths)), 6).alias("score"),
            )
        )
    return profiles.select("profile_id", F.inline(F.array(*entries)))
