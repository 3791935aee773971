"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then three times; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagerisk.plans import catalog  # noqa: E402
from pagerisk.session import build_session, remove_scratch  # noqa: E402

HEADLINE = (
    "clean_url",
    "host_profile",
    "page_text",
    "page_links",
    "merge_pages",
    "assign_batches",
    "page_store",
    "warc_html_pages",
    "url_content_similarity",
    "nearest_document",
    "grammar_error_rate",
    "label_pages",
    "soft_vote",
    "phishing_trace",
    "phishing_trace_large_feed",
    "label_pages_large_corpus",
    "threat_verdict",
    "evaluate_models",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    catalog.load()
    spark = build_session("pagerisk-bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(name, seconds[name], f"(first {runs[0]:.3f})", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline query seconds, median of warm runs, summed",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
