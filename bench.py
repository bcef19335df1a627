"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterloom import session  # noqa: E402
from meterloom.plans import catalog  # noqa: E402

HEADLINE = ["panel_densify", "wide_to_long", "impute_by_sparsity", "clip_day_mad", "winsorize_log", "seasonal_residual", "paa_50", "paa_channels",
            "basic_stats", "percentile_block", "trend_features", "autocorrelation", "missing_profile", "risk_features", "cusum_changepoint", "period_power",
            "fft_block", "rank_auc", "best_f1_threshold", "main_results", "coverage_curve", "gate_table", "gram_matrix", "vote_diversity",
            "consensus_labels", "pair_blends", "cosine_graph", "feature_screen"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session.build(f"local[{cpus}]", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.entries()
    entries["basic_stats"].run(spark, sf).limit(1).collect()  # start the session and the code generator
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.perf_counter()
        entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
