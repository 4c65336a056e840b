"""Benchmark: wall-clock of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed completely with the ``noop`` sink (no driver-side
collect).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q01_prompt_answer_aware",
    "q11_named_splits",
    "q13_batches",
    "q17_pref_pairs_capped",
    "q25_rouge1",
    "q26_rouge2",
    "q27_rougeL",
    "q29_rougeS",
    "q30_rouge_summary",
    "q32b_rouge_long_answers",
    "q33_bertscore",
    "q34_reward_code",
    "q38_html_markdown",
    "q39_vocab",
    "q40_encode",
    "q49_vocab_richness",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from qforge.plans.queries import REGISTRY
    from qforge.session import get_spark

    from qforge.session import input_bytes, scale_conf
    conf = scale_conf(input_bytes([os.path.join(sf_dir, "*.parquet")]), int(cpus))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(conf.pop("spark.sql.shuffle.partitions")),
                      extra=conf)
    # warm-up, not timed: JVM, code generation and Python workers, by running
    # every timed query once on the smallest scale factor
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in (only or HEADLINE):
        if os.path.isdir(warm_dir):
            REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall_clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
