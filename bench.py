"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from turnscope.plans.catalog import QUERIES
from turnscope.session import local_session

HEADLINE = (
    "kpi_summary",
    "kpi_live",
    "running_hit_rate",
    "scan_trace",
    "dedup_anthropic",
    "dedup_turns",
    "merge_roles",
    "merge_turns",
    "clean_payload",
    "ab_scorecard_offline",
    "ab_scorecard_paired",
    "sse_usage_anthropic",
    "sse_text_openai",
    "gemini_to_chat",
    "cache_exact",
    "cache_semantic",
    "cache_lookup",
    "keyword_search",
    "secret_findings",
    "scrub_string",
    "timing_gate",
    "test_offenders",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM's code paths, as in any session that lives longer than a query.
    QUERIES["hit_rate"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found[1]) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
