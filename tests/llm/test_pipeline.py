"""Queries against SQL, and the pipeline against a plain version of the same stages."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_oracles  # noqa: E402
import corpus_pipeline  # noqa: E402
from docloom.llm import decontamination, mixing, simhash  # noqa: E402
from docloom.llm.oracles import ORACLES  # noqa: E402
from docloom.llm.queries import QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(check_oracles, "QUERIES", QUERIES)
    monkeypatch.setattr(check_oracles, "ORACLES", ORACLES)
    assert check_oracles.compare(spark, check_oracles.database(DATA), DATA, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_document(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert rows.select("doc_id").distinct().count() == rows.count() == 200


def test_stages_keep_columns_and_rows(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd_docs, DATA)
        assert out.columns == odd_docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd_docs.schema], name
        assert stage(spark, odd_docs.limit(0), DATA).count() == 0, name


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, DATA).collect()
    split = [(r, (r.text or "").split("\n")) for r in kept]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    counts = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    texts = {r.doc_id: "\n".join(x for x in lines if counts[key(x)] < 10) for r, lines in split}
    sources = {r.doc_id: r.source for r in kept}
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [d for d in texts if find(d) == d and not any(i in decontamination.normalised(texts[d]) for i in items)]
    frame = spark.createDataFrame([(d, texts[d], sources[d]) for d in clean], "doc_id long, text string, source string")
    want = {r.doc_id: r.epochs for r in mixing.mix(frame).collect() if r.epochs}
    got = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == want
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got.collect())
