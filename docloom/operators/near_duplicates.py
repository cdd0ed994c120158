"""Near-duplicate images by the Hamming distance of 64-bit hashes.

An image is dropped when a kept earlier image is fewer than five bits away. Equal
hashes are one group from the start: they share every distance, so the earliest image
stands for all. What remains is bounded by geometry, not by the data: at most 679,120
other hashes lie within four bits of one hash.
"""

from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.operators.graphs import components
from docloom.operators.sizing import broadcast_if_small
from docloom.session import with_checkpoints

# Ship `_decided_in_order` with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_DISTANCE = fv.NEAR_DUPLICATE_BITS - 1
BANDS = MAX_DISTANCE + 1  # two hashes within four bits agree on at least one of five bands
HOT_BUCKET_ROWS = 2_000
GROUP_PAIRS = 200_000
BUCKET = ["job_id", "mask", "value"]


def _bit_counts() -> Column:
    ones = [F.sum(F.shiftright("hash64", b).bitwiseAND(F.lit(1))) for b in range(64)]
    return F.array(*ones)


def _band_masks() -> Column:
    """Five masks, each fixing a fifth of the bits a bucket leaves free.

    The free bits are dealt out from the most to the least evenly filled, so that every
    band gets its share of the bits that tell the members of this bucket apart.
    """
    return F.expr(
        f"""transform(sequence(0, {BANDS - 1}), band -> aggregate(
            filter(
                array_sort(transform(
                    filter(sequence(0, 63), b -> (shiftright(mask, b) & 1) = 0),
                    b -> struct(abs(2 * ones[b] - n) as unevenness, b as bit))),
                (free, i) -> i % {BANDS} = band),
            mask, (fixed, free) -> fixed | shiftleft(1L, free.bit)))"""
    )


def _split(rows: DataFrame) -> DataFrame:
    """Every row in the five narrower buckets of its bucket."""
    shapes = rows.groupBy(*BUCKET).agg(F.count("*").alias("n"), _bit_counts().alias("ones"))
    masks = shapes.select(*BUCKET, _band_masks().alias("masks"))
    narrower = rows.join(masks, BUCKET).select("job_id", "hash64", "seq", F.explode("masks").alias("mask"))
    return narrower.withColumn("value", F.col("hash64").bitwiseAND(F.col("mask")))


def distinct_hashes(images: DataFrame) -> DataFrame:
    """job_id, hash64, seq: the earliest image of each hash; images without a hash have no duplicate."""
    return images.filter("hash64 is not null").groupBy("job_id", "hash64").agg(F.min("seq").alias("seq"))


def _buckets(hashes: DataFrame) -> DataFrame:
    """Each hash in the buckets where it can meet its neighbours.

    A bucket with more than HOT_BUCKET_ROWS members is split again by the bits its
    members may still differ in: two members within four bits also agree on one of five
    bands of those bits. No pair is lost and no candidate is dropped. Every split fixes a
    fifth of the free bits, and ten free bits leave at most 1024 members, so the splitting
    ends after a few rounds.
    """
    with_checkpoints(hashes.sparkSession)
    whole = F.lit(0).cast("bigint")
    level = _split(hashes.withColumn("mask", whole).withColumn("value", whole)).checkpoint()
    done = []
    while True:
        counts = level.groupBy(*BUCKET).agg(F.count("*").alias("n"))
        hot = counts.filter(F.col("n") > HOT_BUCKET_ROWS).select(*BUCKET)
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, [*done, level])
        done.append(level.join(hot, BUCKET, "left_anti"))
        level = _split(level.join(hot, BUCKET, "left_semi")).checkpoint()


def near_pairs(images: DataFrame) -> DataFrame:
    """job_id, earlier, later: pairs of distinct hashes fewer than five bits apart."""
    rows = _buckets(distinct_hashes(images))
    left = rows.select(*BUCKET, F.col("seq").alias("earlier"), F.col("hash64").alias("h1"))
    right = rows.select(*BUCKET, F.col("seq").alias("later"), F.col("hash64").alias("h2"))
    near = F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))) <= MAX_DISTANCE
    return (
        left.join(right, BUCKET)
        .filter((F.col("earlier") < F.col("later")) & near)
        .select("job_id", "earlier", "later")
        .distinct()
    )


def _decided_in_order(pairs: pd.DataFrame) -> pd.DataFrame:
    """The images of one component that a pass in input order drops."""
    dropped: set = set()
    rows = pairs.sort_values(["job_id", "later", "earlier"])
    for job, earlier, later in zip(rows["job_id"], rows["earlier"], rows["later"], strict=True):
        if (job, earlier) not in dropped:
            dropped.add((job, later))
    return pd.DataFrame(sorted(dropped), columns=["job_id", "seq"]).astype({"job_id": pairs["job_id"].dtype, "seq": "int64"})


def _dropped_in_rounds(open_pairs: DataFrame) -> DataFrame:
    """job_id, seq of dropped images, by rounds over the pairs of large components.

    An image all of whose earlier neighbours are dropped is kept, its later neighbours are dropped. A pair leaves
    the table as soon as either side is decided, and each round ends in a checkpoint.
    """
    dropped = open_pairs.select("job_id", F.col("later").alias("seq")).limit(0)
    while not open_pairs.isEmpty():
        firsts = (
            open_pairs.select("job_id", F.col("earlier").alias("seq"))
            .distinct()
            .join(open_pairs.select("job_id", F.col("later").alias("seq")).distinct(), ["job_id", "seq"], "left_anti")
        )
        kept = firsts.withColumnRenamed("seq", "earlier")
        lost = (
            open_pairs.join(kept, ["job_id", "earlier"], "left_semi")
            .select("job_id", F.col("later").alias("seq"))
            .distinct()
            .checkpoint()
        )
        dropped = dropped.unionByName(lost)
        for side in ("earlier", "later"):
            open_pairs = open_pairs.join(lost.withColumnRenamed("seq", side), ["job_id", side], "left_anti")
        open_pairs = open_pairs.checkpoint()
    return dropped


def dropped_images(pairs: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """job_id, seq: what a pass in input order drops, each image that a kept earlier one is near.

    pairs: job_id, earlier, later. What is decided for an image depends on its component of the near graph
    only. A component of up to group_pairs pairs is decided in one task, in order, however long its chains
    are; finding the components takes rounds that follow the logarithm of the longest. Larger components, which
    no task could hold, are decided by rounds over all of them. Nodes are joined by a 64-bit hash of job and
    number: if two meet, their components are decided together, with the same result.
    """
    with_checkpoints(pairs.sparkSession)
    node = lambda side: F.xxhash64("job_id", side)
    joined = components(pairs.select(node("earlier").alias("a"), node("later").alias("b")))
    rooted = pairs.withColumn("node", node("later")).join(joined, "node").select("root", "job_id", "earlier", "later").checkpoint()
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n"))
    large = broadcast_if_small(sizes.filter(F.col("n") > group_pairs).select("root"))
    small = rooted.join(large, "root", "left_anti")
    kind = pairs.schema["job_id"].dataType.simpleString()
    in_order = small.groupBy("root").applyInPandas(_decided_in_order, f"job_id {kind}, seq bigint")
    rest = rooted.join(large, "root", "left_semi").drop("root").checkpoint()
    return in_order.unionByName(_dropped_in_rounds(rest))


def drop_near_duplicates(images: DataFrame) -> DataFrame:
    """The images a pass in input order would keep: each unless a kept earlier one is near. Images without a hash stay."""
    with_checkpoints(images.sparkSession)
    dropped = dropped_images(near_pairs(images).checkpoint())
    keepers = distinct_hashes(images).join(dropped, ["job_id", "seq"], "left_anti")
    hashed = images.filter("hash64 is not null").join(keepers.select("job_id", "seq"), ["job_id", "seq"], "left_semi")
    return hashed.unionByName(images.filter("hash64 is null"))
