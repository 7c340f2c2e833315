"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every query writes its whole
result to a sink that keeps nothing, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from pathpulse.catalog import all_queries
from pathpulse.session import get_session

HEADLINE = """
    track_scan clean_track coordinate_bounds segment_metadata
    feat_basic feat_turning feat_entropy feat_frenetic feat_higuchi feat_spectrum feat_wavelet feat_all
    describe_features equal_freq_crosstab mann_whitney_u levene_f label_correlations
    group_kfold trend_by_condition first_vs_last
    strategy_compare group_vote roc_auc_exact
    nearest_minority smote_balance cv_boosted model_vote permutation_importance
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    queries["class_distribution"](spark, folder).collect()
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
