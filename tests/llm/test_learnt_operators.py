"""Language and quality: scores recomputed in plain Python from the fitted models, stretches, reruns, few labels."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language, quality, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain_subwords(text):
    octets = f" {' '.join(text.lower().split())} ".encode()
    counts = Counter()
    for width in (1, 2, 3, 4):
        for i in range(len(octets) - width + 1):
            code = octets[i]
            for c in octets[i + 1 : i + width]:
                code = (code * 257 + c) % 2**32
            mixed = (code ^ (width * 0x9E3779B1 % 2**32)) * 0x85EBCA6B % 2**32
            counts[(mixed ^ mixed >> 15) % language.BUCKETS] += 1
    return counts


def test_language_equals_plain_scores(spark, docs):
    model = language.train(docs.filter("doc_id % 3 > 0"))
    rows = docs.select("text", language.language(F.col("text"), model, spark).alias("f")).limit(60).collect()
    for r in rows:
        if not language.has_letter(r.text):
            assert r.f.lang_pred == "und"
            continue
        counts = plain_subwords(r.text)
        total = sum(counts.values())
        logits = [sum(n / total * model.table[b, y] for b, n in counts.items()) / model.temperature for y in range(len(model.labels))]
        top = max(logits)
        weights = [math.exp(x - top) for x in logits]
        best = weights.index(max(weights))
        assert r.f.lang_pred == model.labels[best] and r.f.score == pytest.approx(weights[best] / sum(weights), abs=1e-5)
        assert r.f.rejected == (r.f.score < model.threshold)


def plain_terms(text):
    counts = Counter()
    kinds = []
    for octet in text.encode():
        sign = int(quality._SIGN[octet])
        if not kinds or sign != kinds[-1] or sign > 4:
            kinds.append(sign)
    run = [0, 0, *kinds, 0]
    for width in (2, 3):
        for i in range(2 - width + 1 if width < 3 else 0, len(run) - width + 1):
            code = 0
            for sign in run[i : i + width]:
                code = code * quality.SIGNS + sign
            counts[(code * 0x9E3779B1 + width) % 4294967291 % (quality.SHAPES - 2) + 2] += 1
    words = text.split()
    counts[0] = sum(a == b for a, b in zip(words, words[1:]))
    counts[1] = max(0, len(words) - 1) - counts[0]
    octets = f" {' '.join(text.lower().split())} ".encode()
    slot = lambda code, slots: ((code ^ code >> 29) * int(quality._SPREAD) % 2**64) >> (65 - slots.bit_length())
    for word in octets.split():
        code = sum(c * pow(int(quality._FACTOR), i + 1, 2**64) for i, c in enumerate(word)) % 2**64
        counts[quality.SHAPES + slot(code, quality.WORDS)] += 1
    for i in range(len(octets) - 3):
        counts[quality.SHAPES + quality.WORDS + slot(int.from_bytes(octets[i : i + 4], "big"), quality.GRAMS)] += 1
    return {t: n for t, n in counts.items() if n}


@pytest.mark.parametrize("stretch", [1 << 16, 7])
def test_terms_equal_plain_counts(docs, monkeypatch, stretch):
    monkeypatch.setattr(quality, "STRETCH", stretch)
    monkeypatch.setattr(language, "STRETCH", stretch)
    texts = [r.text or "" for r in docs.limit(25).collect()] + ["a", " ", "A1!é中🎉 b b", "x" * 50, "\n\n12"]
    for text in texts:
        text = text[:3000] if stretch < 10 else text
        terms, counts = quality.term_counts(text)
        assert dict(zip(terms.tolist(), counts.tolist())) == (plain_terms(text) if text else {})
        assert Counter(dict(enumerate(language.subword_counts(text).tolist()))) == plain_subwords(text)


def test_quality_equals_plain_votes(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels.filter("doc_id % 3 > 0"))
    rows = docs.select("text", quality.quality_score(F.col("text"), model, spark).alias("s")).limit(40).collect()
    for r in rows:
        counts = plain_terms(r.text or "")
        vector = np.zeros(model.axes.shape[1])
        for first, last, share in quality.GROUPS:
            own = {t: n for t, n in counts.items() if first <= t < last}
            values = {t: math.sqrt(n / sum(own.values())) * model.weights[t] for t, n in own.items()}
            length = math.sqrt(sum(v * v for v in values.values()))
            for t, v in values.items():
                vector += v / length * math.sqrt(share) * model.axes[t]
        norm = np.linalg.norm(vector)
        cosines = [round(float(v @ vector / norm), 9) if norm > 1e-12 else 0.0 for v in model.vectors]
        least = sorted(cosines, reverse=True)[min(quality.NEIGHBOURS, len(cosines)) - 1]
        votes = [(math.exp(model.sharpness * (c - max(cosines))), y) for c, y in zip(cosines, model.labels) if c >= least]
        assert r.s == pytest.approx(sum(v for v, y in votes if y) / sum(v for v, _ in votes), abs=1e-3)


def test_vectors_tell_words_apart(spark):
    """Texts of one shape and other words differ, and labels that only words explain are learnt."""
    good = ["the quick brown fox ate our hens", "our hens were quick and brown", "brown hens ate the fox"]
    bad = ["buy cheap pills now from our shop", "our shop has cheap pills now", "cheap shop pills buy now"]
    rows = [(i, f"{t} {w}", int(t in good)) for i, (t, w) in enumerate((t, w) for t in good + bad for w in ("ab cd", "ef gh ij", "k", "lm nop", "qr"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.train(frame, frame.select("doc_id", "label"))
    a, b = model.project([quality.term_counts(t) for t in ("buy cheap pills now from our shop", "the quick brown fox ate our hens")])
    assert a @ b < 0.8
    asked = spark.createDataFrame([("the brown fox and the hens",), ("pills from the cheap shop",)], "text string")
    scores = [r.s for r in asked.select(quality.quality_score(F.col("text"), model, spark).alias("s")).collect()]
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_reruns_agree_where_ids_repeat(spark):
    rows = [(i % 40, f"{'abc def' if i % 2 else 'xyz uvw'} {i} word{i % 7}", "en" if i % 2 else "fr", i % 2) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    labels = frame.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")).distinct()
    seen = set()
    for parts in (1, 7):
        model = quality.train(frame.repartition(parts, "text"), labels, total=60)
        spoken = language.train(frame.repartition(parts, "text"), total=60)
        assert len(model.labels) == 60
        seen.add((model.vectors.round(6).tobytes(), np.abs(spoken.table).round(6).tobytes()))
    assert len(seen) == 1


def test_one_label_and_empty_tables(spark, docs, tmp_path):
    one = docs.withColumn("lang", F.lit("en"))
    model = language.train(one)
    assert model.labels == ["en"]
    good = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, label int")
    scores = docs.select(quality.quality_score(F.col("text"), quality.train(docs, good), spark).alias("s")).distinct().collect()
    assert [r.s for r in scores] == [1.0]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (queries.op2_language, queries.op9_quality):
        assert query(spark, str(tmp_path)).count() == 0


def test_fit_holds_one_square_array(docs):
    """The driver's memory in a fit: the rows' products or the axes, and small blocks."""
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, quality.TERMS, 40)).astype(np.int32), None) for _ in range(2000)]
    rows = [(terms, np.ones(len(terms), np.float32)) for terms, _ in rows]
    tracemalloc.start()
    quality.fit(rows, np.arange(2000) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * 2000**2 + (12 << 20)


def test_counts_reach_the_driver_packed(docs):
    texts = [r.text for r in docs.select("text").limit(50).collect()] + ["", None]
    for text in texts:
        terms, counts = quality._unpacked(quality._packed(text))
        plain = quality.term_counts(text)
        assert terms.tolist() == plain[0].tolist() and np.allclose(counts, plain[1])
    full = max((t for t in texts if t), key=len)
    assert len(quality._packed(full)) < 5 * len(quality.term_counts(full)[0])
