"""Time the headline jobs: one JSON line on stdout.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.operators import anomaly, distribution, explain, profile, quality  # noqa: E402
from plumbline.plans import queries  # noqa: E402
from plumbline.plans.report import build_report  # noqa: E402
from plumbline.plans.retail import stored_retail, table  # noqa: E402
from plumbline.sources import readers  # noqa: E402
from plumbline.sources.storage import new_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


def session(folder: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def profile_all(df):
    for part in profile.complete_profile(df).values():
        part.collect()


def quality_all(df):
    assessment = quality.assess(df).pinned()
    quality.overall_quality(assessment).collect()
    quality.quality_dimensions(assessment).collect()
    quality.quality_issues(assessment).collect()


def distribution_one(df, column):
    kind, summary = distribution.summarize_column(df, column)
    summary.collect()


def anomalies_all(df):
    found = anomaly.review(df)
    anomaly.method_counts(found).collect()
    anomaly.anomaly_summary(found).collect()
    anomaly.retail_context(found).collect()
    explain.explain_rows(found, anomaly.anomaly_page(found)).collect()


def report_all(df):
    for part in build_report(df).tables.values():
        part.collect()


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        run(folder)


def run(folder: str) -> None:
    spark = session(folder)
    csv = f"{folder}/lineitem.csv"
    table(spark, SF_DIR, "lineitem").write.csv(csv, header=True)
    jobs = {
        "store_retail": lambda: stored_retail(spark, SF_DIR).count(),
        "ingest_csv": lambda: readers.ingest_csv(spark, csv, new_path(spark, "bench-ingest")).collect(),
        "profile": lambda: profile_all(stored_retail(spark, SF_DIR)),
        "quality": lambda: quality_all(stored_retail(spark, SF_DIR)),
        "distribution": lambda: distribution_one(stored_retail(spark, SF_DIR), "LineTotal"),
        "anomalies": lambda: anomalies_all(stored_retail(spark, SF_DIR)),
        "report": lambda: report_all(stored_retail(spark, SF_DIR)),
    }
    for name in ("duplicate_rows", "invalid_rows", "column_unique", "numeric_summary", "histogram_full",
                 "time_buckets", "category_top_other", "anomaly_queue", "catalog_latest_distinct",
                 "catalog_find_duplicate", "report_text"):
        def single(key=name):
            queries.REGISTRY[key](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        jobs[name] = single
    times = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)
    rows = table(spark, SF_DIR, "lineitem").agg(F.count("*")).first()[0]
    print(json.dumps({
        "metric": "headline jobs, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "lineitem_rows": rows, "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
