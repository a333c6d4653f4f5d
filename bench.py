"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs end to end from the raw tables, the derivation of its inputs included, and writes every
row to a no-op sink. One untimed query starts the JVM code and the Python workers; nothing is cached
between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from capsieve.plans.registry import QUERIES
from capsieve.session import local_session

HEADLINE = {
    "overlap_pairs": "interval join of two transcripts",
    "risky_candidates": "alignment judged by partners and tokens",
    "alignment_ratios": "alignment with the similarity ratio",
    "quality_gate": "gate without the ratio",
    "quality_gate_ratios": "gate with the ratio",
    "normalized_documents": "caption text of whole documents",
    "comparison_documents": "comparison text of whole documents",
    "numbered_candidates": "catalog, collisions, states, numbering",
    "discovery_counts": "catalog counts",
    "snapshot_full": "snapshot comparison",
    "caption_digests": "rendering and hashing",
    "duplicate_runs": "longest repetition",
    "parsed_events": "event parsing",
    "run_progress": "progress fold",
    "transfer_progress": "transfer log fold",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.ui.showConsoleProgress": "false"})
    names = sys.argv[1:] or list(HEADLINE)
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("risky_candidates")
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
                "jvm": spark._jvm.java.lang.System.getProperty("java.version"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
