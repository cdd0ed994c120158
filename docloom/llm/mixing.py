"""Mixing sources to target weights by budgets of words.

Documents get hash-random keys and lie in ranges of them within their source. Word counts
are summed per range, the ranges' sums are added up, and rows are added up inside their
range: prefix sums for all documents of a source without one task seeing them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import with_checkpoints

WORD = r"[^\x20\x09-\x0D]+"
KEY_DIGITS = 15
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, text: Column) -> Column:
    """Fifteen hexadecimal digits that depend on the document alone."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(both), 1, KEY_DIGITS)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """source_key, source_size, target: one row per source, from rows source_key, size.

    Sources rank by code point, null last, and weigh as listed, over and over. Together they
    get share times all sizes; a source stops at most times its size and its excess goes to
    the others by weight. In order of (most * size / weight), take all sources before one as full
    and share the rest by weight from there on: the level rises while the next source is full
    too and falls after, so the largest one is where resharing ends. This table has a row a source.
    """
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source_key.known").desc(), "source_key.name"))
    table = F.array(*[F.lit(w) for w in weights])
    weighed = by_source.withColumn("weight", F.get(table, (rank - 1) % len(weights)))
    full = most * F.col("source_size")
    fill = Window.orderBy((full / F.col("weight")).asc(), "source_key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    leveled = weighed.withColumn(
        "level",
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0)))
        / F.sum("weight").over(rest),
    )
    return leveled.withColumn("at", F.max("level").over(whole)).select(
        "source_key", "source_size", F.least(full.cast("double"), F.col("at") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """doc_id, source, sort_key, size, source_size, target, epochs, taken for every row of docs.

    epochs says how often the mix repeats the document, taken is epochs times its size. A
    source is repeated whole as often as its target holds it; of the rest, documents in
    key order are taken while more than half of the document lies within the budget, so the
    sum is off by half a document at most. Null texts and texts without words have size 0 and
    cost nothing; they come once with every whole pass and with the part before the cut. Documents
    with a null source are a source of their own. Repeated rows lie next to each other.
    """
    named = F.struct(F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name"))
    with_checkpoints(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        "source",
        named.alias("source_key"),
        word_count(F.col("text")).alias("size"),
        random_key(F.col("doc_id"), F.col("text")).alias("sort_key"),
    ).withColumn("range", F.substring("sort_key", 1, RANGE_DIGITS)).checkpoint()
    ranges = rows.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    goals = targets(ranges.select("source_key", F.col("range_size").alias("size")), weights, share, most)
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        "source_key", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start")
    ).join(goals, "source_key")
    inside = Window.partitionBy("source_key", "range").orderBy("sort_key", "doc_id", "size")
    placed = rows.join(starts, ["source_key", "range"]).withColumn(
        "before", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.col("target") - F.col("passes") * F.col("source_size")
    extra = (2 * F.col("before") + F.col("size") < 2 * budget).cast("bigint")
    return (
        placed.withColumn("passes", passes.cast("bigint"))
        .withColumn("epochs", F.col("passes") + extra)
        .select(
            "doc_id", "source", "sort_key", "size", "source_size", "target", "epochs",
            (F.col("epochs") * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """All columns of docs and mix_epoch: each document as often as the mix takes it, from 1 up.

    Documents that the mix does not reach are left out. Rows that agree in doc_id, text and source
    are one document here, taken as often as all of them together.
    """
    epoch = "mix_epoch"
    while epoch in docs.columns:
        epoch += "_"
    key = ["sort_key", "sourced", "named"]
    own = [F.col("source").isNotNull().alias("sourced"), F.coalesce("source", F.lit("")).alias("named")]
    times = (
        mix(docs, weights, share, most)
        .groupBy("sort_key", *own)
        .agg(F.sum("epochs").alias("times"))
        .filter("times > 0")
    )
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        random_key(F.col("doc_id"), F.col("text")).alias("sort_key"),
        *own,
    )
    taken = whole.join(times, key).dropDuplicates(key)
    return taken.select("doc.*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias(epoch))
