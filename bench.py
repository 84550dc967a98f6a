"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  Each query runs into the
``noop`` sink, so all its columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from quorumlab.catalog import load
from quorumlab.session import local_session

HEADLINE = [
    "a01_fedavg", "a02_median", "a03_trimmed_mean", "a04c_multi_krum", "a05_norm_clip", "a07_fltrust",
    "a08_fltrust_clip", "a09f_foolsgold", "a10_rlr", "a12_satrust", "p06_deduplicate", "p08_cleaning_report",
    "p09_balance_sample", "p11_split", "p13_dirichlet", "p14_label_skew", "x01_inject_phrase", "t02_rare_token_rate",
    "t05_vocabulary", "t07_word_frequency", "k02_classification", "k10_evaluation_rows", "r09_defense_summary",
    "m01_client_updates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("k01_confusion")  # start the executor threads and the code cache
    timings = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
