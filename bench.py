"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

HEADLINE = (
    "sync_filter", "asset_summary", "weekly_resample", "regime_moments", "regime_var_es", "corr_matrix", "static_backtest", "drawdown_metrics", "rolling_risk_shares", "one_sided_serving", "retro_average",
    "kruskal_h", "ks_stat", "ar1_expanding", "gmm_fit", "ar_multihorizon", "bootstrap_corr", "backtest_unconditional",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{Path(__file__).parent}:{os.environ.get('PYTHONPATH', '')}"
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, str(Path(__file__).parent))
    from tidemark.plans.registry import QUERIES

    QUERIES["asset_summary"](spark, folder).collect()  # starts Python workers and compiles
    took = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query profits from another's panel
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
