"""Headline timings: prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from cohortlens.operators import features as K, inference as I, models as M  # noqa: E402
from cohortlens.plans import load  # noqa: E402
from cohortlens.plans.registry import cases  # noqa: E402
from cohortlens.session import ship_package  # noqa: E402

HEADLINE = ["auc_by_period", "auc_by_group", "auc_decompose", "auc_by_annotation", "ppv_by_percentile", "roc_grid",
            "threshold_for_ppv", "missing_profile", "group_quantiles", "midrank", "rolling_outliers", "expanding_folds",
            "fdr", "cluster_bootstrap", "sequential_monitor", "nearest_match", "duplicate_rows", "tokens"]


def bootstrap(t, reps, scheme):
    """J7 over all orders: Poisson multiplicities in one pass, or exact stratified draws."""
    cs = cases(t).select("caseid", F.col("st").alias("outcome"), "g", (F.col("yr") >= 1999).cast("bigint").alias("y"), "score")
    return I.decompose_bootstrap(cs, ["outcome"], "g", ["score", "caseid"], reps, 4, scheme=scheme)


def sub_models_100(t):
    """L5: one model per group, 100 groups x 6 folds over all line items."""
    li = t("lineitem").select(F.year("l_shipdate").cast("bigint").alias("yr"), (F.col("l_suppkey") % 100).alias("g"),
                              (F.col("l_returnflag") == "R").cast("bigint").alias("y"), (F.col("l_quantity") / 50).alias("x1"),
                              (F.col("l_extendedprice") / 1e5).alias("x2"), (F.col("l_discount") * 10).alias("x3"))
    return M.fit_by_group(K.expanding_folds(li, "yr", "y"), ["g"], ["x1", "x2", "x3"])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    registry = load()
    jobs = {name: (lambda q=registry[name]: q.run(spark, folder)) for name in HEADLINE}
    read = lambda table: spark.read.parquet(f"{folder}/{table}.parquet")
    jobs["decompose_bootstrap_poisson_200"] = lambda: bootstrap(read, 200, "poisson")
    jobs["decompose_bootstrap_poisson_1000"] = lambda: bootstrap(read, 1000, "poisson")
    jobs["decompose_bootstrap_exact_200"] = lambda: bootstrap(read, 200, "exact")
    jobs["sub_models_100_groups"] = lambda: sub_models_100(read)
    registry["auc_by_period"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
