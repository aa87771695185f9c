"""Headline queries, cold (nothing materialised is reused), best of one run.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_value", "redact_string", "match_ladder", "merge_nodes", "merge_edges", "dedupe_evidence", "clusters",
    "impact_of", "trace_path", "most_connected", "canonical_order", "suspect_projects", "basename_join",
    "dotenv_hints", "k8s_workloads", "precision_recall", "content_hash",
]
TABLES = [
    "fx_env", "fx_nodes", "fx_aliases", "fx_edges", "fx_readings", "fx_files", "fx_manifests", "fx_decls",
    "fx_decl_projects", "fx_expected",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from archgraph.plans.catalog import QUERIES
    from archgraph.plans.registry import Inputs
    from archgraph.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "archgraph.input.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # the derived input tables stand for data at rest; writing them is reported
    # on its own and not charged to the first query that reads them
    t0 = time.perf_counter()
    inputs = Inputs(spark, sf_dir)
    for name in TABLES:
        getattr(inputs, name)
    setup = time.perf_counter() - t0
    from archgraph.plans.registry import forget_stages

    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        forget_stages()
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "input_tables_sec": round(setup, 3), "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
