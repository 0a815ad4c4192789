"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, to time a few of them
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicspan.plans.queries import REGISTRY  # noqa: E402
from topicspan.session import local_session  # noqa: E402

HEADLINE = [
    "token_counts",
    "tf_idf",
    "top_tf_idf_words",
    "ngram_counts",
    "top_terms",
    "log_ratio",
    "label_suggestions",
    "clustered_docs",
    "new_text_tf_idf",
    "feature_rows",
    "stratified_split",
    "lda_top_terms",
    "lda_clustered_docs",
    "classify_topics",
    "classifier_test",
    "stream_topic_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["default_label_table"](spark, sf_dir).collect()  # start the workers
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    result = {
        "metric": "topic_analysis_total_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
