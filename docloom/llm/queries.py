"""One query for each operator, over whole driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    clustering, decontamination, embeddings, fill_in_middle, language, line_dedup, mixing, pii, preferences, quality, simhash,
    token_counts, warc,
)
from docloom.llm.samples import fold

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024
QUALITY_THRESHOLD = 0.3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hexadecimal(column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.filter(fold(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True))
    found = docs.select("doc_id", held_out.alias("held_out"), language.language(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc.doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.col("matches.item_id").alias("item_ids"),
        F.col("matches.n_edits").alias("n_edits"),
    )


def op5_drop_shared_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), min_bytes=0)


def op7_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    chosen, rejected = preferences.with_stale_reply(table(spark, folder, "conversations"))
    pairs = preferences.format_pairs(chosen, rejected)
    runs = lambda mask: F.array_join(
        F.transform(mask, lambda r: F.concat(r["n_chars"].cast("string"), F.when(r["trained"], "t").otherwise("x"))), ","
    )
    return pairs.withColumns({c: runs(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"), radius=2, shingle_words=3)
    return groups.withColumn("fingerprint", hexadecimal("fingerprint"))


def quality_model(spark: SparkSession, folder: str, docs: DataFrame):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    score = quality.quality_score(F.col("text"), quality_model(spark, folder, docs), spark)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True))
    scored = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = token_counts.load_vocabulary(public_tokenizers.path(VOCABULARY))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_counts.token_count(F.col("text"), vocabulary, spark).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(table(spark, folder, "embeddings"), n=16, rounds=3, seed=1, size=64)


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = docs.select("doc_id", pii.personal_data(F.col("text"), pii.train(docs), spark).alias("spans"))
    base = F.filter("spans", lambda s: s["is_base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind))
    counts = [of_kind(kind).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"), seed=1, plain_percent=10, spm_percent=20)
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_vectors, op2_language, op3_mix_sources, op4_decontaminate, op5_drop_shared_lines,
        op6_warc_round_trip, op7_preference_pairs, op8_simhash, op9_quality, op10_token_counts,
        op11_centroid_clusters, op12_personal_data, op13_fill_in_middle,
    )
}
