"""The stored index: same rows as the whole tables, and little of it read."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import hits
from docloom.operators import index, retrieval
from docloom.sources import index_store

PAGES = "doc_id string, source_file string, page_number long, text string"


def scans(df):
    """Files, bytes of files and rows of each Parquet scan that the executed plan read."""
    df.collect()
    found = []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "FileSourceScanExec":
            metrics, values = plan.metrics().iterator(), {}
            while metrics.hasNext():
                pair = metrics.next()
                values[pair._1()] = pair._2().value()
            found.append(values)
        children = plan.children().iterator()
        while children.hasNext():
            walk(children.next())

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def pages(spark):
    body = F.concat(F.lit("page about w"), F.col("id"), F.lit(" and w"), F.col("id") % 50, F.lit(" it's 5"))
    rows = spark.range(4000).select(
        F.concat(F.lit("d"), F.floor(F.col("id") / 2)).alias("doc_id"), F.lit("f.pdf").alias("source_file"),
        (F.col("id") % 2 + 1).alias("page_number"), F.concat(body, F.repeat(F.lit(" filler"), 50)).alias("text"),
    )
    return rows.unionByName(spark.createDataFrame([("it's \\", "g.pdf", 1, "it's o'clock at C:\\dir")], PAGES))


@pytest.fixture(scope="module")
def store(spark, pages, tmp_path_factory):
    folder, patch = str(tmp_path_factory.mktemp("store")), pytest.MonkeyPatch()
    patch.setattr(index_store, "BUCKET_BYTES", 100_000)
    rows, size = index_store.measure(pages)
    assert rows == 4001 and size == sum(len(r.text) for r in pages.collect())
    index_store.write_postings(index.postings(pages), f"{folder}/postings", size)
    index_store.write_pages(pages, f"{folder}/pages", size)
    patch.undo()
    return folder


def test_buckets_follow_the_data(spark, store):
    assert index_store.buckets_for(0) == index_store.buckets_for(1) == 1
    assert [index_store.buckets_for(n * index_store.BUCKET_BYTES) for n in (1, 2, 3, 1000, 10**9)] == [1, 2, 4, 1024, 8192]
    assert index_store.buckets_of(spark, f"{store}/pages") == 16


def test_page_look_up_reads_few_rows(spark, pages, store):
    wanted = spark.createDataFrame([(f"d{i}",) for i in range(0, 1000, 100)] + [("it's \\",), ("none",), (None,)], "doc_id string")
    found = index_store.read_pages(spark, f"{store}/pages", wanted)
    want = pages.join(wanted, "doc_id", "left_semi").select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 21
    (scan,) = scans(found.select("doc_id", "text"))
    assert scan["numOutputRows"] < 400 and scan["numPartitions"] <= 12


def test_keyword_look_up_reads_few_rows(spark, pages, store):
    terms = spark.createDataFrame([(f"w{i}",) for i in range(100, 3900, 600)] + [("o'clock",), ("absent",)], "keyword string")
    found = index_store.read_postings(spark, f"{store}/postings", terms)
    all_postings = index.postings(pages)
    want = all_postings.join(terms, "keyword", "left_semi").select(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() >= 7
    (scan,) = scans(found)
    assert scan["numOutputRows"] < all_postings.count() / 4


def test_look_ups_of_many_keys_join(spark, pages, store, monkeypatch):
    wanted = spark.createDataFrame([(f"d{i}",) for i in range(30)], "doc_id string")
    few = index_store.read_pages(spark, f"{store}/pages", wanted).collect()
    monkeypatch.setattr(index_store, "LITERAL_KEYS", 10)
    many = index_store.read_pages(spark, f"{store}/pages", wanted)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few)) and len(few) == 60
    assert index_store.read_pages(spark, f"{store}/pages", wanted.limit(0)).count() == 0


def test_answers_from_the_store_equal_those_of_the_tables(spark, pages, store):
    asked = spark.createDataFrame([(1, "w7 filler"), (2, "nothing here"), (3, "w9 o'clock")], "query_id long, query string")
    terms = retrieval.query_terms(asked)
    postings = index_store.read_postings(spark, f"{store}/postings", terms)
    read = lambda wanted: index_store.read_pages(spark, f"{store}/pages", wanted)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(retrieval.answer(asked, postings, read)) == order(retrieval.answer(asked, index.postings(pages), pages))
    words = terms.select("keyword")
    assert order(retrieval.keyword_lookup(words, postings, read)) == order(retrieval.keyword_lookup(words, index.postings(pages), pages))


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_by_ranges_equal_a_window(spark, parts):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 5).cast("bigint").alias("query_id"), F.concat(F.lit("d"), "id").alias("doc_id"),
        (F.col("id") % 2).alias("page_number"), F.round(F.col("id") % 17 / 10, 1).alias("score"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = retrieval.rank_all_pages(rows)
    tasks = got.filter("query_id = 1").select(F.spark_partition_id()).distinct().count()
    got = sorted(map(tuple, got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(map(tuple, retrieval.rank_pages(rows).collect())) and len(got) == 3000
    assert parts == 1 or tasks > 3


def test_a_store_of_lists_equals_a_store_of_rows(spark, pages, store, tmp_path, monkeypatch):
    monkeypatch.setattr(hits, "GATHERED_ROWS", 5000)
    few = pages.unionByName(spark.createDataFrame([("empty", "h.pdf", 1, ""), ("none", "h.pdf", 2, None)], PAGES))
    lists = index.gathered_postings(few)
    assert sorted(map(str, index.scattered(lists).collect())) == sorted(map(str, index.postings(pages).collect()))
    sizes = [r.n for r in lists.select(F.size("refs").alias("n")).collect()]
    assert len(sizes) < index.postings(pages).count() / 2 and max(sizes) <= 5000 + hits.SLICE_WORDS
    index_store.write_postings(lists, str(tmp_path), index_store.measure(pages)[1])
    for terms in (["filler", "w7", "absent", None], []):
        terms = spark.createDataFrame([(t,) for t in terms], "keyword string")
        rows, listed = (index_store.read_postings(spark, folder, terms) for folder in (f"{store}/postings", str(tmp_path)))
        assert sorted(map(tuple, rows.select(listed.columns).collect())) == sorted(map(tuple, listed.collect()))
    assert index.scattered(index.gathered_postings(pages.limit(0))).count() == 0


def test_ranks_and_counts_come_from_one_pass(spark, pages, monkeypatch):
    asked = spark.createDataFrame([(1, "w7 filler"), (2, "nothing here"), (3, "w9 o'clock page"), (4, "w7 w49")], "query_id long, query string")
    terms = retrieval.query_terms(asked)
    postings = index.postings(pages)
    matched = retrieval.matched_pages(terms, postings)
    for parts in (1, 7, 1024):
        monkeypatch.setattr(retrieval, "_PARTS", parts)
        top, counts = retrieval.counted_top(terms, postings, 5)
        want = retrieval.rank_pages(matched, 5).select(top.columns)
        assert sorted(map(str, top.collect())) == sorted(map(str, want.collect())) and top.count() == 15
        assert sorted(map(str, counts.collect())) == sorted(map(str, retrieval.match_counts(matched).select(counts.columns).collect()))
    read = []
    monkeypatch.setattr(retrieval, "term_postings", lambda t, p, made=retrieval.term_postings: read.append(1) or made(t, p))
    retrieval.answer(asked, postings, lambda wanted: pages.join(wanted, "doc_id", "left_semi")).collect()
    assert len(read) == 1
