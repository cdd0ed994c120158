"""Which images show which products or services.

Input items: job_id, item_id, name, tags, pages (pages that mention the item, array of
struct doc_id, page_number). Input analyses: job_id, image_id, description, tags,
suggested_associations, is_product, source_doc, source_page.

The three published tests are each turned into an equi join that cannot miss a pair:
a piece of the name inside the text, one of the rarest tags in common, the same page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import with_checkpoints

# Longer pieces are rarer: an eight-character one is found in few texts that lack the name.
PIECE_CHARS = 8
DIRECT_NAMES = 256  # different names of a job up to which each text is compared with each name


def _shuffled(side: DataFrame) -> DataFrame:
    """A side that grows with the input: joined by a shuffle, so that the driver never gathers it for a broadcast."""
    return side.hint("merge")


def tag_overlap(tags1: Column, tags2: Column) -> Column:
    """Jaccard share of case-folded tags, 0 when either side has none."""
    a, b = F.transform(tags1, F.lower), F.transform(tags2, F.lower)
    either_empty = F.coalesce((F.size(a) == 0) | (F.size(b) == 0), F.lit(True))
    return F.when(either_empty, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def _pieces(text: Column, sizes: Column) -> Column:
    """Distinct substrings of the lengths in an array."""

    def of(n: Column) -> Column:
        last = F.length(text) - n + 1
        return F.when(
            last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, n))
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def _longest_pieces(name: Column) -> Column:
    n = F.least(F.length(name), F.lit(PIECE_CHARS))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n))
    )


def _piece_sizes(names: DataFrame) -> DataFrame:
    """job_id, sizes: the piece lengths that occur in each job, at most PIECE_CHARS numbers."""
    size = F.least(F.length("name"), F.lit(PIECE_CHARS))
    return names.groupBy("job_id").agg(F.collect_set(size).alias("sizes"))


def _rarest(rows: DataFrame, owner: list[str], key: str, counts: DataFrame, keep: Column | int) -> DataFrame:
    """The keys of each owner with the fewest occurrences on the other side."""
    order = Window.partitionBy(*owner).orderBy(F.coalesce("n", F.lit(0)), key)
    ranked = rows.join(_shuffled(counts), ["job_id", key], "left").withColumn("r", F.row_number().over(order))
    return ranked.filter(F.col("r") <= keep).drop("r", "n")


def _found_by_pieces(names: DataFrame, texts: DataFrame) -> DataFrame:
    """job_id, t, name: texts (job_id, t) that hold a name (job_id, name).

    Texts are cut into pieces of the lengths that their own job's names have, once, and only pieces that are in a name are kept.
    """
    keys = names.select("*", F.explode(_longest_pieces(F.col("name"))).alias("piece"))
    cut = texts.join(_shuffled(_piece_sizes(names)), "job_id")
    pieces = cut.select("job_id", "t", F.explode(_pieces(F.col("t"), F.col("sizes"))).alias("piece"))
    pieces = pieces.join(_shuffled(keys.select("job_id", "piece").distinct()), ["job_id", "piece"], "left_semi").checkpoint()
    counts = pieces.groupBy("job_id", "piece").agg(F.count("*").alias("n"))
    keys = _rarest(keys, ["job_id", "name"], "piece", counts, 1)
    found = pieces.join(_shuffled(keys), ["job_id", "piece"]).filter(F.contains("t", F.col("name")))
    return found.select("job_id", "t", "name")


def name_matches(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """job_id, item_id, image_id where the name occurs in the description or an association.

    A text that holds the name holds every piece of it; the join uses the piece that
    is rarest among the texts. Equal names and equal texts are compared once. In a job of up to DIRECT_NAMES
    different names a text is compared with each of them: that is no more work than its pieces, and moves none.
    """
    with_checkpoints(items.sparkSession)
    texts = analyses.select(
        "job_id",
        "image_id",
        F.explode(F.concat(F.array("description"), F.coalesce("suggested_associations", F.array().cast("array<string>")))).alias("t"),
    ).select("job_id", "image_id", F.lower("t").alias("t")).filter("t is not null")
    names = items.select("job_id", "item_id", F.lower("name").alias("name")).filter("name <> ''")

    kinds = names.select("job_id", "name").distinct()
    per_job = kinds.groupBy("job_id").agg(F.count("*").alias("names"))
    distinct = texts.select("job_id", "t").distinct().join(_shuffled(per_job), "job_id").checkpoint()
    kinds = kinds.join(_shuffled(per_job), "job_id").checkpoint()
    few, many = F.col("names") <= DIRECT_NAMES, F.col("names") > DIRECT_NAMES
    each = kinds.filter(few).groupBy("job_id").agg(F.collect_list("name").alias("candidates"))
    direct = distinct.filter(few).join(_shuffled(each), "job_id").select(
        "job_id", "t", F.explode(F.filter("candidates", lambda name: F.contains(F.col("t"), name))).alias("name")
    )
    found = direct.unionByName(_found_by_pieces(kinds.filter(many).drop("names"), distinct.filter(many).drop("names")))
    return (
        found.select("job_id", "name", "t")
        .join(_shuffled(names), ["job_id", "name"])
        .join(_shuffled(texts), ["job_id", "t"])
        .select("job_id", "item_id", "image_id")
        .distinct()
    )


def _tag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tags, F.lower)))


def tag_matches(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """Pairs whose tag overlap exceeds one half.

    Overlap above one half means more than half of the item's tags are shared, so one
    of its rarest ceil(n / 2) tags is among them. Equal tag sets are compared once.
    """
    a = items.select("job_id", "item_id", _tag_set(F.col("tags")).alias("item_tags"))
    b = analyses.select("job_id", "image_id", _tag_set(F.col("tags")).alias("image_tags"))
    image_sets = b.select("job_id", "image_tags").distinct()
    image_rows = image_sets.select("*", F.explode("image_tags").alias("tag"))
    counts = image_rows.groupBy("job_id", "tag").agg(F.count("*").alias("n"))
    item_sets = a.select("job_id", "item_tags").distinct()
    item_rows = _rarest(
        item_sets.select("*", F.explode("item_tags").alias("tag")),
        ["job_id", "item_tags"], "tag", counts, F.ceil(F.size("item_tags") / 2),
    )
    found = (
        image_rows.join(_shuffled(item_rows), ["job_id", "tag"])
        .filter(tag_overlap(F.col("item_tags"), F.col("image_tags")) > 0.5)
        .select("job_id", "item_tags", "image_tags")
        .distinct()
    )
    return (
        found.join(_shuffled(a), ["job_id", "item_tags"]).join(_shuffled(b), ["job_id", "image_tags"])
        .select("job_id", "item_id", "image_id")
    )


def page_matches(items: DataFrame, analyses: DataFrame) -> DataFrame:
    """Pairs where the image sits on a page that mentions the item."""
    places = items.select("job_id", "item_id", F.inline("pages"))
    images = analyses.select(
        "job_id", "image_id", F.col("source_doc").alias("doc_id"), F.col("source_page").alias("page_number")
    )
    return images.join(_shuffled(places), ["job_id", "doc_id", "page_number"]).select("job_id", "item_id", "image_id").distinct()


def associate(items: DataFrame, analyses: DataFrame, flag: str = "is_product") -> DataFrame:
    """job_id, item_id, image_id for images with the flag that pass any of the three tests."""
    shown = analyses.filter(F.col(flag))
    return (
        name_matches(items, shown)
        .unionByName(tag_matches(items, shown))
        .unionByName(page_matches(items, shown))
        .distinct()
    )


def unassociated(analyses: DataFrame, associations: DataFrame) -> DataFrame:
    """Images without any product or service."""
    return analyses.join(_shuffled(associations.select("job_id", "image_id")), ["job_id", "image_id"], "left_anti")
