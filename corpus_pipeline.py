"""A training corpus from documents: scored, deduplicated, decontaminated and mixed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All
but the last return the columns of documents, also where these have names of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, line_dedup, mixing, near_copies, quality, simhash
from docloom.llm.queries import QUALITY_THRESHOLD, quality_model, table
from docloom.session import new_folder

ORACLE_SQL = None  # classifier, fingerprints and alignments are not SQL


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Its labels are those of sf_dir, learnt on docs."""
    score = quality.quality_score(F.col("text"), quality_model(spark, sf_dir, docs), spark)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), score.alias("score"))
    return kept.filter(F.col("score") >= QUALITY_THRESHOLD).select("doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows the text."""
    kept = line_dedup.drop_shared_lines(docs, min_docs=10, min_chars=1)
    changed = F.col("n_dropped") > 0
    doc = F.when(changed, F.col("doc").withField("text", F.col("kept_text"))).otherwise(F.col("doc")).alias("doc")
    out = kept.select(doc, "kept_text", changed.alias("changed"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("changed"), F.length("kept_text").cast(kind)).otherwise(F.col("doc.n_chars"))
        out = out.withColumn("doc", F.col("doc").withField("n_chars", length))
    return out.select("doc.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash over five-word shingles, a similarity of 0.8 or more verified.

    Copies beyond the reach of the fingerprints are found by tables over the shingles themselves.
    """
    return simhash.keep_one(docs, near_copies.near_groups(docs, shingle_words=5))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("matches") == 0).select("doc.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by mix_epoch."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination_stage),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
