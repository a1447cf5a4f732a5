"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Each query is run to its end once, into the no-op
sink, after a small warm-up job; building the plan is part of its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteroster.plans import QUERIES  # noqa: E402
from siteroster.session import build_session  # noqa: E402

HEADLINE = [
    "fmt_detailed", "deobfuscate", "email_match", "email_context", "phone_extract", "url_extract",
    "page_text", "page_links", "page_headings", "page_parse", "social_links", "contacts_extract",
    "contact_report", "cat_email", "cat_domain", "business_type", "budget_check", "size_budget", "rate_gap",
    "domain_stats", "session_stats", "robots_filter", "frontier_bfs", "crawl_report", "dedup_by_key",
    "chunk_rows", "summary_stats", "clean_text", "hash_text", "enc_dataset", "sink_multi", "job_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    only = sys.argv[1:] or HEADLINE
    times = {}
    for name in only:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
