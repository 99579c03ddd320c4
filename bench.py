"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the no-op sink (every row produced, nothing
collected).  Times exclude JVM start-up; one warm-up query runs first.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lethe.queries import QUERIES  # noqa: E402
from lethe.session import local_session  # noqa: E402

HEADLINE = [
    "a10_gradient",               # gradient over all lineitem rows
    "a12_hessian",                # dense Hessian partials
    "a13_hvp",                    # Hessian-vector product
    "u1_gradient_diff_numeric",   # change-set gradient (feature removal)
    "u11_feature_unlearning_report",
    "w1_w2_roc_pr_auc",
    "e1_e3_text_entries",         # bag of words over documents
    "a6_document_frequency",
    "m5_softmax_gradient",
    "u10_sharded_unlearning",     # keyed Newton over shards
    "x2_perplexity_distribution", # character model + sampled sequences
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(int(cpus) * 2, 8) if cpus != "*" else 16, app="lethe-bench")
    QUERIES["a8_sample_loss"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
