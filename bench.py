"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from civitext.plans.queries import QUERIES  # noqa: E402
from civitext.session import get_session  # noqa: E402

HEADLINE = [
    "scan_labelled",
    "stratified_split",
    "clean_reasons",
    "clean_generated",
    "augmentation_impact",
    "token_counts",
    "vocab_first_seen",
    "vocab_topk",
    "encode_tokens",
    "decode_tokens",
    "tfidf_weights",
    "dedup_first_seen",
    "neutral_candidates",
    "pool_refresh",
    "max_anchor_cosine",
    "binary_metrics",
    "read_text_robust",
    "tfidf_lr_predict",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    # Starts the session; not recorded.
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
