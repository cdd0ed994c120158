"""Near copies by SimHash and by covering masks over shingle bits, verified by the shingle sets themselves.

Sets whose SimHash fingerprints are within two bits meet in buckets that the links of `simhash` give.
These are the copies that differ little. Fingerprints of less similar sets are further apart (at 0.8 about ten bits
differ), so the masks go on where SimHash ends, over the shingles instead of the fingerprint's bits. A text is a set of shingles, that is a long vector with one bit for each possible shingle. As the
masks of `simhash` deal the bits of a fingerprint, structured masks deal these bits to K classes, K
being the power of two above a quarter of the set's size; a table keeps the bits of one class. Sets
with a Jaccard similarity of 0.8 differ in fewer than K bits, so some classes hold none of them: both
sets land in one bucket of such a table. Up to eight shingles, similar sets differ by one
shingle that one of them lacks: the key of the whole smaller set is one of the keys that leave one
shingle out of the larger.

Sets are made once, for texts that share a bucket with others, and tasks compare whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.components import components
from docloom.llm.simhash import ROW_KEY, row_key, shingle_hashes, text_hash
from docloom.operators.sizing import broadcast_if_small
from docloom.session import new_folder, with_checkpoints

TILE = ["key", "one", "two"]
SMALL = 8  # shingles up to which sets meet by whole and partial keys
TWICE = 32  # shingles below which two independent deals are made: classes are few and may be empty
ROUNDS = [2, 8]  # tables below these numbers are compared in the first and second round
PIVOTS = 16
BLOCK_SHINGLES = 1 << 20
PARTS = 128
POINT_TYPE = "point bigint, n bigint, fp bigint, keys array<bigint>, whole array<bigint>, parts array<bigint>"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels_of(size: int) -> list[int]:
    """Binary logarithms of the class counts a set of this size takes part in.

    Sizes 2^(b+1) to 2^(b+2) - 1 have 2^b classes. Similar sets differ by a quarter in size at
    most, so a set less than that above the border also uses the classes below it.
    """
    level = max(0, size.bit_length() - 2)
    both = level and 4 * size < 5 << (level + 1)
    return [level, level - 1] if both else [level]


def small_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the whole set (4 to 7 shingles), and keys that leave one shingle out (5 to 8); else none.

    Of two such sets with a similarity of 0.8 or more, one is the other and a shingle.
    """
    n, none, content = len(shingles), np.zeros(0, np.uint64), _mix(shingles, 16)
    total = content.sum(dtype=np.uint64)
    whole = _mix(np.array([total]), 20 + n) if 4 <= n < SMALL else none
    return whole, _mix(total - content, 19 + n) if 4 < n <= SMALL else none


def class_keys(shingles: np.ndarray, tables: int) -> np.ndarray:
    """A key for each table (deal, level, class below `tables`) in which the set has a shingle; none for sets under SMALL.

    The last two bits of a key tell the round of its table.
    """
    n = len(shingles)
    if n < SMALL:
        return np.zeros(0, np.uint64)
    content, keys = _mix(shingles, 12), []
    for deal in range(2 if 4 * n < 5 * TWICE else 1):  # a set a quarter larger still meets the smaller one
        place = _mix(shingles, 11 + 30 * deal)
        for level in levels_of(n):
            number = place & np.uint64((1 << level) - 1)
            kept = np.flatnonzero(number < tables)
            kept = kept[np.argsort(number[kept], kind="stable")]
            used, starts = np.unique(number[kept], return_index=True)
            if len(used):
                salt = _mix(used + np.uint64((deal << 40) + (level << 32)), 13)
                mixed = _mix(np.add.reduceat(content[kept], starts) ^ salt, 14)
                turn = np.searchsorted(ROUNDS, used, side="right") if not deal else np.full(len(used), len(ROUNDS))
                keys.append((mixed & ~np.uint64(3)) | turn.astype(np.uint64))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def table_keys(shingles: np.ndarray, tables: int) -> np.ndarray:
    """All keys by which the set meets others."""
    return np.concatenate([class_keys(shingles, tables), *small_keys(shingles)])


def _set(text: str | None, shingle_words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle_words), np.uint64))


def points_of(docs: DataFrame, shingle_words: int, tables: int) -> DataFrame:
    """doc_id, text_hash, point, n, fp, keys, whole, parts for every row of docs; equal shingle sets have equal points.

    fp is the SimHash of the set: a repeated shingle counts once, as in the similarity.
    """

    @F.pandas_udf(POINT_TYPE)
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                shingles = _set(text, shingle_words)
                whole = _mix(np.array([_mix(shingles, 15).sum(dtype=np.uint64)]), len(shingles))
                keys = (k.view(np.int64) for k in (class_keys(shingles, tables), *small_keys(shingles)))
                rows.append((int(whole.view(np.int64)[0]), len(shingles), simhash.fingerprint_of(shingles), *keys))
            yield pd.DataFrame(rows, columns=["point", "n", "fp", "keys", "whole", "parts"])

    text = F.col("text")
    return docs.select("doc_id", text_hash(text).alias("text_hash"), describe(text).alias("d")).select("doc_id", "text_hash", "d.*")


def small_links(points: DataFrame, similarity: float) -> DataFrame:
    """a, b: small sets and the sets of one shingle more that hold them; few a larger set, whatever the key's rows."""
    wholes = points.select(F.col("point").alias("a"), F.explode("whole").alias("key"))
    parts = points.filter(F.col("n") - 1 >= F.col("n") * F.lit(similarity))
    parts = parts.select(F.col("point").alias("b"), F.explode("parts").alias("key"))
    return wholes.join(parts, "key").select("a", "b")


def with_simhash_keys(points: DataFrame, radius: int) -> DataFrame:
    """points, with keys added for their own fingerprint and for the fingerprints that the links of SimHash lead to.

    Two fingerprints within `radius` bits share a bucket of a covering table and there lead to the same one, so their
    points meet. A fingerprint leads to one other a table at most. These buckets are compared in the first round.
    """
    joined = simhash.links(points.select("fp").distinct(), radius).checkpoint()
    stars = joined.groupBy(F.col("a").alias("fp")).agg(F.collect_set("b").alias("stars"))
    led = F.concat(F.array("fp"), F.coalesce("stars", F.array().cast("array<bigint>")))
    keys = F.transform(led, lambda fp: F.xxhash64(F.lit("simhash"), fp).bitwiseAND(F.lit(-4)))
    return points.join(stars, "fp", "left").withColumn("keys", F.concat("keys", keys)).drop("stars")


def shared_buckets(points: DataFrame) -> DataFrame:
    """key, point, n: members of the buckets with company.

    Copies that differ little share most of their buckets: of buckets with the same members one is kept.
    """
    rows = points.select("point", "n", F.explode("keys").alias("key"))
    turn = F.col("key").bitwiseAND(F.lit(3))
    counts = rows.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("point")).alias("x"), F.bit_xor(F.xxhash64("point", F.lit(1))).alias("y")
    )
    crowded = counts.filter("members > 1").groupBy("members", "x", "y").agg(F.min_by("key", F.struct(turn, F.col("key"))).alias("key"))
    return rows.join(crowded.select("key"), "key").select("key", "point", "n")


def _blocks(rows: Column, shingles: Column, block_rows: int) -> Column:
    return F.greatest(F.ceil(rows / block_rows), F.ceil(shingles / BLOCK_SHINGLES)).cast("bigint")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("point"), F.greatest(blocks, F.lit(1)))


def first_tiles(members: DataFrame, block_rows: int) -> DataFrame:
    """key, one, two, point: each bucket in blocks by a hash of the point, with the bucket's PIVOTS first points in every block.

    What resembles a pivot joins across blocks here; later rounds look at the rest.
    """
    sizes = members.groupBy("key").agg(_blocks(F.count("*"), F.sum("n"), block_rows).alias("blocks"))
    rows = members.join(sizes, "key")
    block = rows.select("key", _own(F.col("blocks")).alias("one"), "point")
    order = Window.partitionBy("key").orderBy(F.xxhash64("point", F.lit(2)), "point")
    first = rows.filter("blocks > 1").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= PIVOTS)
    everywhere = first.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("one"), "point")
    return block.unionByName(everywhere).distinct().select("key", "one", F.lit(0).cast("bigint").alias("two"), "point")


def open_tiles(members: DataFrame, block_rows: int) -> DataFrame:
    """key, one, two, point, root: tiles of the buckets whose members have several roots.

    Members of one root need no comparison. In each bucket the most frequent root's members make blocks
    of their own, which meet every block of the others; the others' blocks meet each other. Every
    pair of different roots is in some tile, and a bucket that is nearly joined is moved about once.
    """
    per_root = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    buckets = per_root.groupBy("key").agg(
        F.count("*").alias("roots"), F.max(F.struct("c", "s", "root")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s")
    ).filter("roots > 1")
    buckets = buckets.select(
        "key", F.col("most.root").alias("most"), _blocks(F.col("most.c"), F.col("most.s"), block_rows).alias("k"),
        _blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s"), block_rows).alias("l"),
    )
    rows = members.join(buckets, "key")
    frequent = F.col("root") == F.col("most")
    up_to = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    pair = lambda a, b: F.struct(a.alias("one"), b.alias("two"))
    mine = F.when(frequent, _own(F.col("k"))).otherwise(_own(F.col("l")))
    rows = rows.select("key", "point", "root", "k", "l", frequent.alias("frequent"), mine.alias("mine"))
    mine = F.col("mine")
    with_others = F.transform(up_to(F.col("l")), lambda j: pair(mine, j))
    with_frequent = F.transform(up_to(F.col("k")), lambda i: pair(i, mine))
    others = F.filter(up_to(F.col("l")), lambda q: q != mine)
    among = F.transform(others, lambda q: pair(-F.least(q, mine) - 1, F.greatest(q, mine)))
    tiles = F.when(F.col("frequent"), with_others).otherwise(F.concat(with_frequent, among))
    return rows.select("key", "point", "root", F.explode(tiles).alias("t")).select("key", "t.one", "t.two", "point", "root")


class Sets:
    """The shingle sets of one tile, with counts by parts of the hash range that bound what two sets share."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity = sets, similarity
        self.sizes = np.array([len(s) for s in sets])
        self.counts = np.stack([np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=PARTS) for s in sets]).astype(np.int32)

    def like(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose similarity to the pivot is high enough."""
        n, s = self.sizes[pivot], self.similarity
        sizes = self.sizes[others]
        others = others[(np.minimum(sizes, n) >= s * np.maximum(sizes, n) - 1e-9)]
        bound = np.minimum(self.counts[others], self.counts[pivot]).sum(axis=1)
        others = others[bound >= s * (n + self.sizes[others] - bound) - 1e-9]
        own, found = self.sets[pivot], []
        for other in others.tolist():
            x = self.sets[other]
            at = np.searchsorted(own, x)
            at[at == n] = 0
            shared = int((own[at] == x).sum())
            if shared >= s * (n + len(x) - shared):
                found.append(other)
        return np.array(found, np.int64)


def joined_members(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between members of different roots that join all that resemble each other; one a join.

    From each root, the smallest first, the search goes on through what it joins; the last root has nobody left to meet.
    """
    tile, links = Sets(sets, similarity), []
    names, group, members = np.unique(roots, return_inverse=True, return_counts=True)
    by_root = np.split(np.argsort(group, kind="stable"), np.cumsum(members)[:-1])
    left = np.ones(len(sets), bool)
    for g in np.argsort(members, kind="stable").tolist():
        if not left[by_root[g][0]]:
            continue
        queue, at = by_root[g].tolist(), 0
        left[by_root[g]] = False
        while at < len(queue):
            others = np.flatnonzero(left)
            if not len(others):
                return links
            for other in tile.like(queue[at], others).tolist():
                if left[other]:
                    links.append((queue[at], other))
                    found = by_root[group[other]]
                    left[found] = False
                    queue += found.tolist()
            at += 1
    return links


def links(tiles: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of points of different roots in one tile that are similar, as many as join all that are.

    tiles: key, one, two, point, root; sets: point, shingles (binary, sorted 64-bit hashes).
    """

    def join_tile(rows: pd.DataFrame) -> pd.DataFrame:
        members = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        found = joined_members(members, rows["root"].to_numpy(np.int64), similarity)
        points = rows["point"].to_numpy(np.int64)
        a, b = (points[[pair[side] for pair in found]] for side in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    def join_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            marks = batch[TILE].to_numpy()
            changes = (np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()
            for i, j in zip([0, *changes], [*changes, len(batch)], strict=True):
                name = tuple(marks[i].tolist())
                if rest and name != last:
                    yield join_tile(pd.concat(rest, ignore_index=True))
                    rest = []
                last = name
                rest.append(batch.iloc[i:j])
        if rest:
            yield join_tile(pd.concat(rest, ignore_index=True))

    rows = tiles.join(sets, "point").select(*TILE, "point", "root", "shingles")
    sorted_rows = rows.repartition(*TILE).sortWithinPartitions(*TILE)
    return sorted_rows.mapInPandas(join_tiles, "a long, b long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """point, shingles: the sets of the wanted points (point, row), each from one of its rows, found by the row's own key."""

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_set(t, shingle_words).tobytes() for t in texts])

    own = docs.select(*row_key(F.col("doc_id"), text_hash(F.col("text"))), "text")
    rows = broadcast_if_small(wanted.select("point", "row.*"))
    texts = own.join(rows, ROW_KEY).groupBy("point").agg(F.first("text").alias("text"))
    return texts.select("point", shingles("text").alias("shingles"))


def joined_points(docs: DataFrame, points: DataFrame, shingle_words: int, similarity: float, block_rows: int, radius: int) -> DataFrame:
    """node, root: the components of the points that similar pairs join.

    Buckets are compared in rounds. The first takes the links of SimHash and few tables, which join most copies; later rounds
    move only buckets whose members are still in different components.
    """
    buckets = shared_buckets(with_simhash_keys(points, radius)).checkpoint()
    wanted = points.join(buckets.select("point").distinct(), "point", "left_semi")
    sets = sets_of(docs, wanted, shingle_words).checkpoint()
    turn = F.col("key").bitwiseAND(F.lit(3))
    tiles = first_tiles(buckets.filter(turn == 0), block_rows).withColumn("root", F.col("point"))
    joined = components(links(tiles, sets, similarity).unionByName(small_links(points, similarity)).checkpoint())
    for number in range(1, len(ROUNDS) + 1):
        # in the second round also what the blocks of the first left apart
        rows = buckets.filter(turn <= 1 if number == 1 else turn == number)
        rows = rows.join(joined.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
        tiles = open_tiles(rows, block_rows).checkpoint()
        left = sets.join(broadcast_if_small(tiles.select("point").distinct()), "point", "left_semi")
        found = links(tiles, left, similarity).checkpoint()
        if not found.isEmpty():
            joined = components(found.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return joined


def near_groups(
    docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, tables: int = 24, block_rows: int = 2048, radius: int = 2
) -> DataFrame:
    """doc_id, text_hash, group_id, component_id for every row of docs (doc_id, text).

    Texts link when the Jaccard similarity of their sets of shingles is at least `similarity`, never below it:
    sets are compared in full (for similarities of 0.8 and more, which the tables fit). Up to eight
    shingles all such pairs are found. Larger sets are compared where SimHash fingerprints within `radius` bits join
    them, and where they share a bucket of `tables` tables; a pair at exactly 0.8 shares none with a chance of about 1 in 10,000, and none at
    all where its clean classes are empty (8 to 31 shingles, of two deals: about as rare).

    Equal shingle sets are one point, so copies are never paired. Null or empty texts and texts
    of white space are copies of each other and of nothing else. Repeated rows stay. group_id
    is a point of the group, component_id its least doc_id (null where no row has one). Other
    columns are not looked at. A text's set is made once where it has company, and no text is moved in rounds.
    """
    spark = docs.sparkSession
    with_checkpoints(spark)
    folder = new_folder(spark, "near-copies")
    points_of(docs, shingle_words, tables).write.parquet(folder)
    marked = spark.read.parquet(folder)
    points = marked.groupBy("point").agg(
        F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("whole").alias("whole"), F.first("parts").alias("parts"),
        F.min(F.struct(*row_key(F.col("doc_id"), F.col("text_hash")))).alias("row"),
    )
    joined = joined_points(docs, points, shingle_words, similarity, block_rows, radius).withColumnRenamed("node", "point")
    rooted = marked.groupBy("point").agg(F.min("doc_id").alias("least")).join(joined, "point", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "point"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("point", F.col("root").alias("group_id"), "component_id")
    return marked.select("doc_id", "text_hash", "point").join(named, "point").select("doc_id", "text_hash", "group_id", "component_id")
