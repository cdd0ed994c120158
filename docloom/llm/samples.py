"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.sizing import broadcast_if_small


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def share_of(key: Column, n: Column | int, wanted: int) -> Column:
    """Whether the hash of a row's key lies in the share that keeps about `wanted` of n rows."""
    count = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(key), F.lit(1_000_000_000)) / F.lit(1e9) * count < wanted


def even_sample(labelled: DataFrame, per_label: int, total: int) -> DataFrame:
    """doc_id, label: at most per_label rows of each label and total rows, chosen by hash.

    labelled: doc_id, label. Rows without either are not chosen. The choice depends on ids
    alone. Labels are counted first; of a frequent one, ids are thinned by their hash to about
    twice per_label before they are ranked, so no task sees all rows of a label.
    """
    known = labelled.select("doc_id", "label").filter("doc_id is not null and label is not null")
    counts = known.groupBy("label").agg(F.count("*").alias("n"))
    few = known.join(broadcast_if_small(counts), "label").filter(share_of(F.col("doc_id"), F.col("n"), 2 * per_label))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    ranked = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_label)
    return ranked.orderBy("rank", "label").limit(total).select("doc_id", "label")
