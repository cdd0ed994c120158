import datetime
import random

import pytest

from docloom.operators import index, jobs
from docloom.streaming import batches, ingest, job_status

EVENTS = "job_id string, event_id long, ts timestamp, phase string, status string, error string"
START = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(j, i, START + datetime.timedelta(hours=h), p, s, e) for j, i, h, p, s, e in rows], EVENTS)


ROWS = [
    ("ok", 1, 0, "file_discovery", "processing", None), ("ok", 2, 30, "indexing", "processing", None),
    ("ok", 3, 31, "done", "completed", None), ("bad", 4, 0, "file_discovery", "processing", None),
    ("bad", 5, 1, "document_parsing", "processing", None), ("bad", 6, 100, None, "failed", "boom"), ("new", 7, 0, None, "queued", None),
]
EXPECTED = {
    "ok": ("completed", "done", 100.0, None), "bad": ("failed", "document_parsing", 30.0, "boom"), "new": ("queued", None, 0.0, None),
}


def as_dict(df):
    return {r["job_id"]: (r["status"], r["phase"], r["progress"], r["error"]) for r in df.collect()}


def test_latest_status_and_rates(spark):
    latest = jobs.latest_status(events(spark, ROWS))
    assert as_dict(latest) == EXPECTED
    assert {r["status"]: r["jobs"] for r in jobs.count_by_status(latest).collect()} == {"completed": 1, "failed": 1, "queued": 1}
    rates = jobs.outcome_rates(latest).first()
    assert (rates["success_rate"], rates["failure_rate"]) == (0.333333, 0.333333)


def test_late_duplicates_change_nothing(spark):
    assert as_dict(jobs.latest_status(events(spark, [*ROWS, ROWS[0], ROWS[4]]))) == EXPECTED


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_durations_equal_a_plain_window(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.randrange(400) / 4, "indexing", "processing", None) for i in range(120)]
    got = {r["event_id"]: r["seconds"] for r in jobs.phase_durations(events(spark, rows)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 120
    for job in "ab":
        ordered = sorted((h, i) for j, i, h, *_ in rows if j == job)
        for (h, i), following in zip(ordered, [*ordered[1:], None]):
            assert got[i] == (None if following is None else pytest.approx((following[0] - h) * 3600))


def arrive(spark, frame, source):
    frame.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(frame.schema).parquet(source)


def test_status_stream_over_several_arrivals(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for rows in (ROWS[3:5] + ROWS[1:2], ROWS[:1] + ROWS[2:3], ROWS[5:], ROWS[:2]):
        stream = arrive(spark, events(spark, rows), source)
        job_status.start_status_stream(stream, out, log, merge_every=3).awaitTermination()
    assert as_dict(job_status.read_status(spark, out)) == EXPECTED


def write_batch(spark, out, batch, rows, every):
    batches.write_rows(job_status.batch_status(events(spark, rows)), f"{out}/batch={batch}")
    whole = lambda: job_status.merged_status(batches.read(spark, out, before=batch + 1))
    batches.merge(spark, out, batch, every, whole, batches.write_rows)


def test_status_folders_stay_few(spark, tmp_path):
    """However many batches there were, a reader opens one base and fewer than merge_every batches."""
    out, every = str(tmp_path / "s"), 4
    for batch in range(23):
        write_batch(spark, out, batch, [(f"j{batch % 5}", batch, batch, "indexing", "processing", None)], every)
        assert len(batches.folders(spark, out)) <= every
        assert len(list((tmp_path / "s").iterdir())) <= 2 * every + 2
    got = {r.job_id: r.last_event.event_id for r in job_status.merged_status(batches.read(spark, out)).collect()}
    assert got == {"j0": 20, "j1": 21, "j2": 22, "j3": 18, "j4": 19}


def test_repeated_batches_change_nothing(spark, tmp_path):
    out = str(tmp_path / "s")
    write_batch(spark, out, 0, ROWS[:3], 2)
    write_batch(spark, out, 1, ROWS[3:], 2)
    for _ in range(2):  # a batch that failed after its base was written comes again
        write_batch(spark, out, 1, ROWS[3:], 2)
    assert batches.live(spark, out) == (1, [])
    assert as_dict(job_status.read_status(spark, out)) == EXPECTED
    # a base whose write was not finished does not count
    (tmp_path / "s" / "base=1" / "_SUCCESS").unlink()
    assert batches.live(spark, out) == (None, [0, 1])
    assert as_dict(job_status.read_status(spark, out)) == EXPECTED


PAGES = "doc_id string, page_number long, text string"


def ingested(spark, tmp_path, arrivals, merge_every):
    source, out, log = (str(tmp_path / f"{n}{merge_every}") for n in ("in", "out", "log"))
    for rows in arrivals:
        stream = arrive(spark, spark.createDataFrame(rows, PAGES), source)
        pages = ingest.arrived_now(stream.select("*", "_metadata")).drop("_metadata")
        ingest.start_ingest(pages, out, log, merge_every).awaitTermination()
    return out


@pytest.mark.parametrize("merge_every", [1, 2, 50])
def test_pages_that_come_again_replace_their_postings(spark, tmp_path, merge_every):
    arrivals = [
        [("a", 1, "red burger"), ("a", 2, "blue boat"), ("n", 1, None), (None, 1, "lost")],
        [("a", 1, "red burger"), ("b", 1, "green tree")],
        [("a", 2, "blue house"), ("a", 2, "blue house"), ("b", 1, "")],
        [("a", 2, "blue boat")],
        [("a", 1, "red burger"), ("b", 1, "oak tree")],
    ]
    out = ingested(spark, tmp_path, arrivals, merge_every)
    last = [("a", 1, "red burger"), ("a", 2, "blue boat"), ("b", 1, "oak tree"), ("n", 1, None)]
    columns = ["doc_id", "page_number", "keyword", "relevance", "position"]
    want = index.postings(spark.createDataFrame(last, PAGES)).select(columns)
    assert sorted(map(tuple, ingest.read_postings(spark, out).collect())) == sorted(map(tuple, want.collect()))
    terms = spark.createDataFrame([("boat",), ("house",), ("green",), ("tree",)], "keyword string")
    found = {(r.keyword, r.doc_id) for r in ingest.read_postings(spark, out, terms).collect()}
    assert found == {("boat", "a"), ("tree", "b")}
    # the page that came again unchanged was indexed once
    batch = [r.batch for r in batches.read(spark, f"{out}/arrivals").filter("doc_id = 'a' and page_number = 1").collect()]
    assert batch == [0]


def test_ingested_postings_are_kept_in_lists(spark, tmp_path):
    pages = [(f"p{i}", 1, f"shared words and own{i}") for i in range(40)]
    again = [(f"p{i}", 1, f"shared words and new{i}") for i in range(0, 40, 4)]
    for merge_every in (2, 50):
        out = ingested(spark, tmp_path, [pages, again, pages[1:2]], merge_every)
        lists = batches.read(spark, f"{out}/postings", ingest.POSTINGS).filter("keyword = 'shared'").collect()
        assert len(lists) < 20 and sum(len(r.refs) for r in lists) == (40 if merge_every == 2 else 50)
        want = index.postings(spark.createDataFrame(pages + again, PAGES)).collect()
        want = {(r.keyword, r.doc_id, r.position) for r in want if r.keyword[:3] != "own" or int(r.doc_id[1:]) % 4}
        got = [(r.keyword, r.doc_id, r.position) for r in ingest.read_postings(spark, out).collect()]
        assert set(got) == want and len(got) == len(want)
