"""Edits of stored tables: only their buckets are written, and a retried batch applies once."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import profiles
from docloom.sources import edit_store

TABLE = "job_id string, name string, version long, saved_at string"
EDITS = "job_id string, name string, n int"


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edit_store, "buckets_for", lambda size: 8)
    folder = str(tmp_path / "s")
    edit_store.create(spark.createDataFrame([(f"j{i}", f"n{i}", 1, "old") for i in range(40)], TABLE), folder, "job_id")
    return folder


def rows(spark, folder, keys=None):
    return {r.job_id: (r.name, r.version) for r in edit_store.read(spark, folder, keys).collect()}


def upsert(base, edits):
    return profiles.upsert(base, edits, F.lit("now"), "n")


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    def times():
        return {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in (tmp_path / "s" / "data").glob("store_bucket=*")}

    before = times()
    edits = spark.createDataFrame([("j3", "x", 0), ("j3", "y", 1), ("new", "z", 0)], EDITS)
    written = edit_store.apply(spark, store, 5, edits, upsert)
    after = times()
    assert written <= 2 and sum(before.get(k) != after[k] for k in after) == written
    got = rows(spark, store)
    assert len(got) == 41 and got["j3"] == ("y", 3) and got["new"] == ("z", 1) and got["j4"] == ("n4", 1)
    assert rows(spark, store, ["j3", "none"]) == {"j3": ("y", 3)}


def test_a_retried_batch_applies_once(spark, store):
    edits = spark.createDataFrame([(f"j{i}", "e", 0) for i in range(0, 40, 3)], EDITS)
    edit_store.apply(spark, store, 1, edits, upsert)
    once = rows(spark, store)
    assert edit_store.apply(spark, store, 1, edits, upsert) == 0 and rows(spark, store) == once
    edit_store.apply(spark, store, 2, edits, upsert)
    assert {v for _, v in rows(spark, store).values()} == {1, 3}


def test_a_batch_that_failed_between_folders_is_finished(spark, store):
    """Some buckets have the batch, others not: the retry writes the others only."""
    edits = spark.createDataFrame([(f"j{i}", "e", 0) for i in range(40)], EDITS)
    half = edits.filter(edit_store.bucket(F.col("job_id"), 8) < 4)
    first = edit_store.apply(spark, store, 1, half, upsert)
    second = edit_store.apply(spark, store, 1, edits, upsert)
    assert first > 0 and second > 0 and first + second <= 8
    assert set(rows(spark, store).values()) == {("e", 2)}


def test_a_store_can_lose_all_rows(spark, store):
    everything = spark.createDataFrame([(f"j{i}",) for i in range(40)], "job_id string")
    for batch in (1, 1, 2):
        edit_store.apply(spark, store, batch, everything, profiles.delete)
    assert rows(spark, store) == {}
    edit_store.apply(spark, store, 3, spark.createDataFrame([("a", "b", 0)], EDITS), upsert)
    assert rows(spark, store) == {"a": ("b", 1)}
    edit_store.apply(spark, store, 4, spark.createDataFrame([], EDITS), upsert)
    assert rows(spark, store) == {"a": ("b", 1)}
