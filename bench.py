"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores, BENCH_ROUNDS the timed runs of each
query after one warm-up (default 3; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pearson_pairs",
    "pearson_pairs_join",
    "spearman_pairs",
    "rewiring_observed",
    "rewiring_permutation_p",
    "module_overlap_fisher",
    "gene_level_scores",
    "bh_adjust",
    "edge_support",
    "support_cumulative",
    "node_summary_pvalues",
    "edge_summary_pvalues",
    "ols_graph_edges",
    "vbsr_graph",
    "module_discovery",
    "maximal_cliques",
)


def kernel_seconds() -> dict[str, float]:
    """Shapes that the baseline documents, synthetic: one VBSR fit with 15 restarts, and one bootstrap of 50 modules."""
    import numpy as np

    from corrweave.kernels.modules import discover
    from corrweave.kernels.vbsr import vbsr

    rng = np.random.default_rng(0)
    x = rng.normal(size=(97, 200))
    began = time.perf_counter()
    vbsr(x, x[:, :5].sum(1) + rng.normal(size=97))
    fit = time.perf_counter() - began
    regs = rng.normal(size=(200, 121))
    targets = np.vstack([regs[rng.integers(200, size=3)].sum(0) + rng.normal(0, 0.5, (20, 121)) for _ in range(50)])
    began = time.perf_counter()
    discover(np.vstack([regs, targets]), np.arange(1200) < 200, [f"s{k:03d}" for k in range(121)], 50, "LM", 5, 0)
    return {"kernel_vbsr_200x97": round(fit, 3), "kernel_discovery_1200x121": round(time.perf_counter() - began, 3)}


def main() -> None:
    from corrweave.catalogue import QUERIES
    from corrweave.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = get_spark("bench", cpus, int(cpus) if cpus.isdigit() else None)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(rounds + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    seconds |= kernel_seconds()
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}))


if __name__ == "__main__":
    main()
