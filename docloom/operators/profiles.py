"""The profile store and the tables shown from it.

Edits come as tables of changes and are merged by key in one shuffle, so any number of
profiles is edited at once. Services are rows (profile_id, ordinal, ...), never one list
per profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions.lookup import has_number
from docloom.operators.numbering import number_rows

def _last_edits(edits: DataFrame, keys: list[str], data: list[str], order: str | None) -> DataFrame:
    """keys, data of the last edit by the order column, and how many edits there are (edits)."""
    row = F.struct(*[F.col(c) for c in data])
    last = F.max_by(row, F.col(order)) if order else F.max(row)
    return edits.groupBy(*keys).agg(F.count("*").alias("edits"), last.alias("last")).select(*keys, "last.*", "edits")


def upsert(base: DataFrame, updates: DataFrame, saved_at: Column, order: str | None = None) -> DataFrame:
    """Insert or replace by job_id; a written row has a new saved_at, and its version counts its edits.

    Several updates of one key apply in the order of a column: the last one stays. Without that
    column the largest values stay.
    """
    data = [c for c in base.columns if c not in ("job_id", "version", "saved_at")]
    joined = base.alias("b").join(_last_edits(updates, ["job_id"], data, order).alias("u"), "job_id", "full")
    edits = F.coalesce("u.edits", F.lit(0))
    written = edits > 0
    return joined.select(
        "job_id",
        *[F.when(written, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in data],
        (F.coalesce("b.version", F.lit(0)) + edits).alias("version"),
        F.when(written, saved_at).otherwise(F.col("b.saved_at")).alias("saved_at"),
    )


def delete(base: DataFrame, job_ids: DataFrame) -> DataFrame:
    return base.join(job_ids.select("job_id"), "job_id", "left_anti")


def replace_services(services: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Replace whole services by (profile_id, ordinal); changes outside the list are ignored.

    Of several changes of one service the last in the order of a column stays.
    """
    keys = ["profile_id", "ordinal"]
    data = [c for c in services.columns if c not in keys]
    joined = services.alias("b").join(_last_edits(changes, keys, data, order).alias("u"), keys, "left")
    return joined.select(
        *keys, *[F.when(F.col("u.edits") > 0, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in data]
    )


def with_service_id(services: DataFrame) -> DataFrame:
    return services.withColumn("service_id", F.concat(F.lit("svc_"), "ordinal"))


def append_services(services: DataFrame, added: DataFrame, order: str) -> DataFrame:
    """Add services behind the existing ones, in the order of a whole-number column."""
    counts = services.groupBy("profile_id").agg(F.count("*").alias("existing"))
    numbered = number_rows(added, ["profile_id"], order, "position").join(counts, "profile_id", "left")
    new = numbered.withColumn("ordinal", F.coalesce("existing", F.lit(0)) + F.col("position"))
    new = with_service_id(new.drop("position", "existing", order))
    return services.unionByName(new.select(services.columns))


def delete_services(services: DataFrame, removed: DataFrame) -> DataFrame:
    """Remove services by (profile_id, ordinal), close the gaps and renew the ids."""
    left = services.join(removed.select("profile_id", "ordinal"), ["profile_id", "ordinal"], "left_anti")
    renumbered = number_rows(left, ["profile_id"], "ordinal", "position")
    closed = renumbered.withColumn("ordinal", F.col("position")).drop("position")
    return with_service_id(closed).select(services.columns)


def list_profiles(profiles: DataFrame, services: DataFrame, products: DataFrame) -> DataFrame:
    """Name, type and item counts of each profile, newest first."""

    def counts(items: DataFrame, name: str) -> DataFrame:
        return items.groupBy("profile_id").agg(F.count("*").alias(name))

    return (
        profiles.select(
            "job_id",
            "profile_id",
            F.coalesce("business_info.name", F.lit("Unknown")).alias("business_name"),
            F.coalesce("business_type", F.lit("unknown")).alias("business_type"),
            "saved_at",
        )
        .join(counts(services, "services_count"), "profile_id", "left")
        .join(counts(products, "products_count"), "profile_id", "left")
        .fillna(0, ["services_count", "products_count"])
        .orderBy(F.desc("saved_at"), "job_id")
    )


def all_items(services: DataFrame, products: DataFrame) -> DataFrame:
    """Services, then products, as one list of items."""
    marked = [
        df.withColumn("item_kind", F.lit(kind)).withColumn("list_part", F.lit(part))
        for part, (kind, df) in enumerate((("service", services), ("product", products)))
    ]
    return marked[0].unionByName(marked[1], allowMissingColumns=True)


def flatten_item(item: Column, details: Column) -> Column:
    """Top-level values win unless they are empty; details fill the gaps."""
    filled = lambda v: F.coalesce(v != "", F.lit(False))
    merged = F.map_zip_with(
        F.coalesce(item, F.create_map().cast("map<string,string>")),
        F.coalesce(details, F.create_map().cast("map<string,string>")),
        lambda _, own, other: F.when(filled(own), own).when(filled(other), other).otherwise(own),
    )
    return F.map_filter(merged, lambda _, v: v.isNotNull())


def humanize(key: Column) -> Column:
    """snake_case or camelCase to words with upper first letters."""
    words = F.regexp_replace(F.translate(key, "_-", "  "), "([a-z])([A-Z])", "$1 $2")
    pieces = F.split(words, r"(?<!\w)(?=\w)")
    raised = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.array_join(raised, "")


def badges(items: DataFrame, list_fields: list[str], keys: list[str]) -> DataFrame:
    """keys, field, label, entries: one row per non-empty list field of an item."""

    def entry(field: str) -> Column:
        n = F.size(field)
        label = F.lit("FAQ") if field == "faqs" else humanize(F.lit(field))
        badge = F.struct(
            F.lit(field).alias("field"),
            F.concat(label, F.lit(" ("), n, F.lit(")")).alias("label"),
            n.alias("entries"),
        )
        return F.when(n > 0, badge)

    found = F.filter(F.array(*[entry(f) for f in list_fields]), lambda b: b.isNotNull())
    return items.select(*keys, F.inline(found))


def policy_fields(item: Column) -> Column:
    """Non-empty text fields whose key names a policy."""
    pattern = "|".join(fv.POLICY_WORDS)
    return F.map_filter(item, lambda k, v: k.rlike(pattern) & F.coalesce(v != "", F.lit(False)))


def price_label(base_price: Column, currency: Column) -> Column:
    """Currency and price with thousands separators and at most three decimals; null without a price."""
    shown = F.call_function("format_number", base_price, F.lit("#,##0.###"))
    return F.when(has_number(base_price), F.concat(F.coalesce(currency, F.lit("₹")), shown))


def first_key(item: Column, priorities: list[str]) -> Column:
    """The first listed key that the item has, whatever its value."""
    return F.coalesce(*[F.when(F.map_contains_key(item, p), F.lit(p)) for p in priorities])


def migrate(profiles: DataFrame, target: str, steps: dict[str, dict[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows moved to the target version by the step `from->target`, and rows without such a step.

    A step names the columns it sets. Rows already at the target stay as they are.
    """
    current = F.col("schema_version")
    known = [key.split("->")[0] for key in steps if key.split("->")[1] == target]
    fields = sorted({c for key, sets in steps.items() if key.endswith("->" + target) for c in sets})
    moved = profiles.filter(current.isin([*known, target]))
    changes = {}
    for field in fields:
        value = F.col(field) if field in profiles.columns else F.lit(None)
        for source in known:
            step = steps[f"{source}->{target}"]
            if field in step:
                value = F.when(current == source, step[field]).otherwise(value)
        changes[field] = value
    done = moved.withColumns(changes).withColumn("schema_version", F.lit(target))
    reason = F.concat(F.lit("No migration path from "), current, F.lit(f" to {target}"))
    rejected = profiles.filter(~current.isin([*known, target])).withColumn("error", reason)
    return done, rejected


def profile_parts(profiles: DataFrame, services: DataFrame, documents: DataFrame, part_rows: int = 1000) -> DataFrame:
    """Assembled profiles: information, extraction record and services in runs of part_rows.

    A profile of up to part_rows services is one row; more services continue in further parts.
    Input documents: job_id, documents.
    """
    part = F.floor(F.col("ordinal") / part_rows)
    lists = services.groupBy("profile_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "service_id", "name"))).alias("services")
    )
    return (
        profiles.join(documents, "job_id", "left")
        .join(lists, "profile_id", "left")
        .select(
            "profile_id",
            "job_id",
            "business_type",
            F.col("business_info.name").alias("business_name"),
            F.coalesce("part", F.lit(0)).alias("part"),
            "services",
            F.coalesce("documents", F.lit(0)).alias("source_files_count"),
            (F.coalesce("documents", F.lit(0)) + 2).alias("llm_calls"),
        )
    )


def _by_ordinal(a: Column, b: Column) -> Column:
    """Services hold maps, which have no order of their own."""
    return F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0)


def assemble_profiles(
    docs: DataFrame, types: DataFrame, companies: DataFrame, services: DataFrame, extracted_at: Column, part_rows: int = 1000
) -> DataFrame:
    """Whole profiles of jobs from the answers about their documents, with services in runs of part_rows.

    docs: job_id, doc_id, doc_order (a whole number); types: job_id, business_type; companies: job_id and
    the columns of `company_info`; services: doc_id and the columns of `answers.services`. Every job of docs has a
    profile: without a company answer its information is null, without services its list is null.
    Services follow the order of their documents, in parts of part_rows, so that no row grows without bound.
    """
    fields = [c for c in services.columns if c != "doc_id"]
    placed = services.join(docs, "doc_id").select("job_id", "doc_order", F.struct(*fields).alias("service"))
    numbered = number_rows(placed, ["job_id"], "doc_order", "ordinal")
    lists = numbered.groupBy("job_id", F.floor(F.col("ordinal") / part_rows).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "service")), _by_ordinal).alias("services")
    )
    counted = docs.groupBy("job_id").agg(F.count("*").alias("documents"))
    contact = F.struct("email", "phone", "website").alias("contact")
    info = companies.select("job_id", F.struct("name", "description", "category", contact).alias("business_info"))
    record = F.struct(
        extracted_at.alias("extraction_date"), F.col("documents").alias("source_files_count"),
        (F.col("documents") + fv.EXTRA_CALLS).alias("llm_calls_made"), F.lit(fv.PROFILE_CONFIDENCE).alias("confidence_score"),
        F.lit(fv.EXTRACTION_METHOD).alias("extraction_method"), F.lit(fv.PROFILE_VERSION).alias("version"),
    )
    return (
        counted.join(types, "job_id", "left")
        .join(info, "job_id", "left")
        .join(lists, "job_id", "left")
        .select(
            F.concat(F.lit("profile_"), "job_id").alias("profile_id"), "job_id", "business_type", "business_info",
            F.coalesce("part", F.lit(0).cast("bigint")).alias("part"), "services", record.alias("extraction_metadata"),
        )
    )


def export_json(item: Column) -> Column:
    """The profile as JSON without its internal keys."""
    return F.to_json(F.map_filter(item, lambda k, _: ~F.startswith(k, F.lit("_"))))
