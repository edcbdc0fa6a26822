"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR, BENCH_CPUS choose data and cores; BENCH_QUERIES is a comma separated list of
query names, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

from causeway.plans import registry
from causeway.session import local_session

HEADLINE = (
    "history_top_quarter", "causal_history", "history_asof", "prior_modifications",
    "group_causal_history", "change_features", "cross_features", "diff_features_strict",
    "strategy_commit_stats", "fold_strategy_metrics", "selection_metrics", "per_commit_metrics",
    "roc_auc_global", "average_precision_global", "calibration_error_left", "reliability_table",
    "topk_per_group_floor", "recall_at_budget", "apply_budget", "risk_coverage",
    "commit_uncertainty", "conformal_threshold_pac", "apply_conformal", "selective_policy",
    "sweep_policy", "run_strategies", "reference_baselines", "name_correspondence",
    "nearest_source", "direct_import", "dependency_features", "run_status", "expand_kill_labels",
    "failure_context", "redact_secrets", "message_features", "ingest_junit_executed",
    "ingest_console_log", "temporal_group_split", "cliffs_delta", "signed_rank_statistic",
    "cluster_bootstrap", "fit_risk_model", "fit_temperature", "score_requests", "page_hinkley",
    "resume_ingest",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    spark = local_session(cpus, partitions=max(int(cpus), 1) if cpus.isdigit() else 8, memory="12g")
    queries = registry.queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    timings, failed = {}, {}
    for name in names:
        started = time.perf_counter()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - started, 3)
        except Exception as error:  # one failing query must not hide the others
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        print(f"{name} {timings.get(name, 'FAILED')}", file=sys.stderr, flush=True)
    result = {"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
              "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
              "cpus": cpus}
    if failed:
        result["failed"] = failed
    print(json.dumps(result), flush=True)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
