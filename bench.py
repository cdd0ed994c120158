"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docloom.plans.queries import QUERIES  # noqa: E402
from docloom.session import local_session  # noqa: E402

HEADLINES = [
    "fil11_summary",
    "fil12_directory_nodes",
    "tab11_classify",
    "tab14_count_by_type",
    "kw8_keywords",
    "idx2_relevance",
    "idx3_snippets",
    "idx4_posting_lists",
    "idx10_keyword_stats",
    "idx11_compress",
    "ret6_topk_pages",
    "retrieve_answers",
    "med3_drop_near_duplicates",
    "med6_summary",
    "med10_associations",
    "llm4_service_requests",
    "llm9_analyses",
    "validate_profiles",
    "pro5_delete_services",
    "job1_latest_status",
    "job4_phase_totals",
]


def seconds(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds(spark, folder, "job2_progress")  # start-up of the session, not measured
    times = {name: seconds(spark, folder, name) for name in HEADLINES}
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
