import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import association, media, near_duplicates

IMAGES = (
    "image_id string, seq long, job_id string, width int, height int, file_size long, is_embedded boolean, image_hash string"
)


def images(spark, rows):
    return spark.createDataFrame(rows, IMAGES)


def test_first_of_equal_hashes_stays(spark):
    df = images(spark, [("b", 2, "j", 1, 1, 5, False, "h"), ("a", 1, "j", 1, 1, 7, True, "h"), ("c", 3, "k", 1, 1, 9, True, "h")])
    assert {r["image_id"] for r in media.drop_duplicates(df).collect()} == {"a", "c"}
    counts = {r["job_id"]: r for r in media.extraction_summary(df).collect()}
    assert (counts["j"]["duplicates_removed"], counts["j"]["embedded_count"], counts["j"]["total_size_bytes"]) == (1, 1, 12)
    assert media.drop_duplicates(df.limit(0)).count() == 0


def test_embedded_images_win_over_standalone(spark):
    embedded = images(spark, [("e", 9, "j", 1, 1, 5, True, "h")])
    standalone = images(spark, [("s", 1, "j", 1, 1, 5, False, "h")])
    kept = media.drop_duplicates(media.all_images(embedded, standalone)).collect()
    assert [r["image_id"] for r in kept] == ["e"]


@pytest.mark.parametrize(
    "width, height, resolution, score, standard",
    [
        (1920, 1080, "high", 1.0, True), (1280, 720, "medium", 0.7 + 0.1, True), (640, 480, "low", 0.6, True),
        (100, 100, "very_low", 0.4, True), (3000, 1000, "high", 1.0, False), (500, 0, "very_low", 0.4, True),
        (1000, 100, "very_low", 0.3, False),
    ],
)
def test_quality(spark, width, height, resolution, score, standard):
    row = media.with_quality(images(spark, [("a", 1, "j", width, height, 1, True, "h")])).first()
    assert (row["resolution"], row["standard_ratio"]) == (resolution, standard)
    assert row["quality_score"] == pytest.approx(score)


def test_formats(spark):
    df = spark.createDataFrame([("a.JPEG",), ("b.tiff",), ("c",)], "n string")
    got = df.select(media.image_format(F.col("n")), media.image_format(F.col("n"), "unknown")).collect()
    assert [tuple(r) for r in got] == [("jpg", "jpg"), ("jpg", "unknown"), ("jpg", "unknown")]


def greedy(rows):
    kept, out = {}, set()
    for seq, job, value in sorted(rows):
        if all((value ^ other).bit_count() >= 5 for other in kept.setdefault(job, [])):
            kept[job].append(value)
            out.add(seq)
    return out


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("hot", [2_000, 20])
def test_near_duplicates_equal_one_pass_in_order(spark, monkeypatch, hot):
    """Clusters, chains and exact copies; with the small limit buckets are split again."""
    monkeypatch.setattr(near_duplicates, "HOT_BUCKET_ROWS", hot)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    rows = []
    for seq in range(300):
        value = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            value ^= 1 << rng.randrange(64)
        rows.append((seq, f"job{rng.random() < 0.3}", value))
    df = spark.createDataFrame([(s, j, signed(v)) for s, j, v in rows], "seq long, job_id string, hash64 long")
    kept = {r["seq"] for r in near_duplicates.drop_near_duplicates(df).collect()}
    assert kept == greedy(rows)
    firsts = {}
    for seq, job, value in rows:
        firsts.setdefault((job, value), seq)
    pairs = {(r["earlier"], r["later"]) for r in near_duplicates.near_pairs(df).collect()}
    expected = {
        (a, b)
        for (j, v), a in firsts.items()
        for (k, w), b in firsts.items()
        if j == k and a < b and (v ^ w).bit_count() < 5
    }
    assert pairs == expected


@pytest.mark.parametrize("group_pairs", [200_000, 3])
def test_components_decide_like_a_pass_in_order(spark, group_pairs):
    """Random near graphs over two jobs, decided in one task each or in rounds."""
    rng = random.Random(8)
    pairs = {(f"j{rng.randrange(2)}", *sorted(rng.sample(range(120), 2))) for _ in range(110)}
    frame = spark.createDataFrame(sorted(pairs), "job_id string, earlier long, later long")
    dropped = set()
    for job, earlier, later in sorted(pairs, key=lambda p: (p[2], p[1])):
        if (job, earlier) not in dropped:
            dropped.add((job, later))
    got = [(r.job_id, r.seq) for r in near_duplicates.dropped_images(frame, group_pairs).collect()]
    assert sorted(got) == sorted(dropped) and len(got) > 30
    assert near_duplicates.dropped_images(frame.limit(0)).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rng, value, rows = random.Random(4), 0, []
    for seq in range(1000):
        rows.append((seq, "j", value))
        for bit in rng.sample(range(64), 4):
            value ^= 1 << bit
    df = spark.createDataFrame([(s, j, signed(v)) for s, j, v in rows], "seq long, job_id string, hash64 long")
    kind, rounds = type(df), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: rounds.append(1) or plain(self, *a, **k))
    kept = {r["seq"] for r in near_duplicates.drop_near_duplicates(df).collect()}
    assert kept == greedy(rows) and 400 < len(kept) < 600
    assert len(rounds) < 20


def test_no_near_pairs(spark):
    df = spark.createDataFrame([(1, "j", 0), (2, "j", -1), (3, "j", 0)], "seq long, job_id string, hash64 long")
    assert {r["seq"] for r in near_duplicates.drop_near_duplicates(df).collect()} == {1, 2}


def overlap(a, b):
    a, b = {t.lower() for t in a}, {t.lower() for t in b}
    return len(a & b) / len(a | b) if a and b else 0.0


def test_associations_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["red", "Blue", "car", "a", "ox", "burger", "red car"]
    items = [
        (f"j{rng.randrange(2)}", i, rng.choice([*words, "", None]), rng.sample(words, rng.randrange(4)), [("d%d" % rng.randrange(9), 1)])
        for i in range(60)
    ]
    shown = [
        (
            f"j{rng.randrange(2)}", f"i{i}", " ".join(rng.sample(words, 2)) if rng.random() < 0.9 else None, rng.sample(words, rng.randrange(4)),
            [rng.choice(words)] if rng.random() < 0.5 else [], rng.random() < 0.8, "d%d" % rng.randrange(9), 1,
        )
        for i in range(60)
    ]
    items_df = spark.createDataFrame(
        items, "job_id string, item_id long, name string, tags array<string>, pages array<struct<doc_id:string,page_number:long>>"
    )
    shown_df = spark.createDataFrame(
        shown,
        "job_id string, image_id string, description string, tags array<string>, suggested_associations array<string>,"
        " is_product boolean, source_doc string, source_page long",
    )
    expected = set()
    for job, item, name, tags, places in items:
        for job2, image, text, tags2, more, flag, doc, page in shown:
            texts = [t.lower() for t in [text, *more] if t]
            named = bool(name) and any(name.lower() in t for t in texts)
            if job == job2 and flag and (named or overlap(tags, tags2) > 0.5 or (doc, page) in places):
                expected.add((job, item, image))
    found = association.associate(items_df, shown_df)
    assert {tuple(r) for r in found.collect()} == expected
    left = {r["image_id"] for r in association.unassociated(shown_df, found).collect()}
    assert left == {s[1] for s in shown} - {e[2] for e in expected}


@pytest.mark.parametrize("direct", [0, 2, 256])
def test_names_are_found_directly_and_by_pieces(spark, monkeypatch, direct):
    """Jobs of few names compare directly, others by pieces; no side is gathered at the driver for a broadcast."""
    monkeypatch.setattr(association, "DIRECT_NAMES", direct)
    items = [("j", 1, "red car"), ("j", 2, "RED CAR"), ("j", 3, "ox"), ("j", 4, "burger with cheese"), ("k", 5, "ox"), ("k", 6, ""), ("l", 7, "lone")]
    texts = [("j", "a", "A red CAR and an ox"), ("j", "b", "burger with cheese"), ("k", "c", "fox"), ("k", "d", None), ("m", "e", "lone")]
    items_df = spark.createDataFrame(items, "job_id string, item_id long, name string")
    analyses = spark.createDataFrame(texts, "job_id string, image_id string, description string")
    analyses = analyses.withColumn("suggested_associations", F.array().cast("array<string>"))
    found = association.name_matches(items_df, analyses)
    assert {tuple(r) for r in found.collect()} == {("j", 1, "a"), ("j", 2, "a"), ("j", 3, "a"), ("j", 4, "b"), ("k", 5, "c")}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("a, b, share", [(["A", "b"], ["a", "B"], 1.0), (["a", "b"], ["b", "c"], 1 / 3), ([], ["a"], 0.0), (None, ["a"], 0.0)])
def test_tag_overlap(spark, a, b, share):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(association.tag_overlap(F.col("a"), F.col("b"))).first()[0] == pytest.approx(share)


def test_images_without_hash_are_no_duplicates(spark):
    rows = [("j", "a", 1, 5), ("j", "b", 2, None), ("j", "c", 3, None), ("j", "d", 4, 5)]
    images = spark.createDataFrame(rows, "job_id string, image_id string, seq long, hash64 long")
    kept = near_duplicates.drop_near_duplicates(images).collect()
    assert sorted(r["image_id"] for r in kept) == ["a", "b", "c"]


def test_a_missing_list_keeps_the_description(spark):
    items = spark.createDataFrame([("j", "i1", "red chair")], "job_id string, item_id string, name string")
    kind = "job_id string, image_id string, description string, suggested_associations array<string>"
    analyses = spark.createDataFrame([("j", "p1", "A red chair", None)], kind)
    assert [r["image_id"] for r in association.name_matches(items, analyses).collect()] == ["p1"]
