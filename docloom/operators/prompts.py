"""Request rows for a batch language or vision model. The model call itself is elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.operators.documents import service_candidates, text_start

COMPANY_PROMPT = (
    "Find the company's name, description, category, email, phone and website in the text below."
    " Answer with one JSON object only.\n\n"
)
SERVICE_PROMPT = (
    "Describe the offer in the document below as one JSON object with name, description, category, price,"
    " currency, details, inclusions, exclusions, policies and faqs. Use null for missing values.\n\n"
)
IMAGE_PROMPT = (
    "Describe this image as one JSON object with description, category, tags, is_product,"
    " is_service_related, associations and confidence."
)


def _first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The first n documents of each job in document order. Input docs: job_id, doc_id, doc_order."""
    order = Window.partitionBy("job_id").orderBy("doc_order")
    return docs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def _sample(docs: DataFrame, pages: DataFrame, n: int, chars: int) -> DataFrame:
    """job_id, sample: the starts of the first n documents, one after the other."""
    first = _first_documents(docs, n).select("job_id", "doc_id", "n")
    needed = pages.join(first.select("doc_id"), "doc_id", "left_semi")
    parts = first.join(text_start(needed, chars), "doc_id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("t"))))
    return parts.groupBy("job_id").agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "").alias("sample"))


def business_type(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, business_type from words in the start of the first documents."""
    sample = _sample(docs, pages, fv.TYPE_SAMPLE_DOCS, fv.TYPE_SAMPLE_CHARS)
    text = F.lower("sample")
    kind = (
        F.when(text.rlike("|".join(fv.SERVICE_WORDS)), "service")
        .when(text.rlike("|".join(fv.PRODUCT_WORDS)), "product")
        .otherwise("service")
    )
    return sample.select("job_id", kind.alias("business_type"))


def company_requests(docs: DataFrame, pages: DataFrame, prompt: str = COMPANY_PROMPT) -> DataFrame:
    """job_id, input, prompt: one request per job."""
    sample = _sample(docs, pages, fv.COMPANY_SAMPLE_DOCS, fv.COMPANY_SAMPLE_CHARS)
    text = F.substring("sample", 1, fv.COMPANY_PROMPT_CHARS)
    return sample.select("job_id", text.alias("input"), F.concat(F.lit(prompt), text).alias("prompt"))


def service_requests(pages: DataFrame, prompt: str = SERVICE_PROMPT) -> DataFrame:
    """doc_id, doc_name, input, prompt: one request per service candidate."""
    candidates = service_candidates(pages).select("doc_id", "doc_name")
    return candidates.join(text_start(pages, fv.SERVICE_PROMPT_CHARS), "doc_id").select(
        "doc_id", "doc_name", F.col("text").alias("input"), F.concat(F.lit(prompt), "text").alias("prompt")
    )


def image_prompt(context: Column, method: Column, prompt: str = IMAGE_PROMPT) -> Column:
    """Context in front, a note on the extraction method behind."""
    lead = F.when(
        F.coalesce(context != "", F.lit(False)),
        F.concat(
            F.lit("Context from source document:\n"), F.substring(context, 1, fv.IMAGE_CONTEXT_CHARS), F.lit("\n\n")
        ),
    ).otherwise("")
    note = F
    for name, text in fv.IMAGE_METHOD_NOTES.items():
        note = note.when(method == name, text)
    return F.concat(lead, F.lit(prompt), note.otherwise(""))
