"""Headline queries, timed end to end; prints one JSON line.

Each query is built and run once into a no-op sink, after one untimed query has started
the JVM and the Python workers.
"""
from __future__ import annotations

import json
import os
import sys
import time

from filigree.plans.catalog import QUERIES
from filigree.session import build_session

HEADLINE = [
    "search_filings_tool",
    "hybrid_search_topk",
    "lexical_search_topk",
    "lexical_search_chunks",
    "semantic_search_topk",
    "search_balanced_per_source",
    "rrf_fusion",
    "surrounding_chunks_of_hits",
    "postings_build",
    "chunk_documents_200_150",
    "page_chunks",
    "html_to_markdown",
    "filings_select",
    "filings_manifest",
    "grounding_status",
    "citations_for_display",
    "thread_list",
    "thread_access",
    "message_assembly",
    "incremental_ingest_availablenow",
    "streamed_message_commit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("lexical_search_topk")
    seconds = {name: run(name) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
