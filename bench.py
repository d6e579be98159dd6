"""Times headline queries on local Spark and prints one JSON line.

Every query starts from the input tables: shared stages are dropped before each. Two short
queries run first, so that the JVM is warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "brand_volume", "clean_text", "rule_flags", "thread_turns", "thread_quality", "weak_intent",
    "golden_sample", "stratified_split", "class_metrics", "label_merge", "language_gate",
    "tfidf_weights", "sparse_similarity", "retrieve_topk", "agent_decisions", "benchmark_table",
    "dense_topk", "cluster_summary", "intent_classifier_metrics",
]


def main() -> None:
    from registry.queries import QUERIES
    from registry.workspace import forget
    from supportlake.session import drop_scratch, local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")

    def run(name: str) -> float:
        forget()
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    for name in ("clean_text", "thread_roots"):
        run(name)
    times = {}
    for name in names:
        times[name] = run(name)
        print(f"{name:28s} {times[name]:8.2f}s", file=sys.stderr, flush=True)
        drop_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
