"""Time the headline queries over one sample directory; prints one JSON line.

BENCH_SF_DIR names the directory, BENCH_CPUS the local cores, BENCH_RUNS the warm runs per
query, of which the median counts. Every run reads the whole tables and drains the result.
"""

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "card_cells", "mae_delta_card", "dunnett_stats", "rank_arms", "average_summary", "mode_summary",
    "regression_metrics", "rae", "spearman", "kendall", "tidy_metrics", "group_quantiles",
    "profile_columns", "masked_moments", "prescale_tall", "prescale_order_fix", "legacy_rescale",
    "correlation_pairs", "pca_targets", "standardize_keys", "seeded_subset", "drop_leakage",
    "featurize_blocks", "stack_features", "best_single", "stack_report",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from assaybook.plans import QUERIES
    from assaybook.session import release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("assaybook-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="assaybook-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    drain(QUERIES["card_cells"](spark, sf_dir))          # start the JVM's compiler and the
    drain(QUERIES["kendall"](spark, sf_dir))             # Python workers outside the clock
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            drain(QUERIES[name](spark, sf_dir))
            taken.append(time.perf_counter() - start)
            release(spark)                # outside the clock: the next run stages anew
        times[name] = round(statistics.median(taken), 3)
    release(spark)
    spark.stop()
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))


if __name__ == "__main__":
    main()
