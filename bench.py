"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import re
import time

from leadloom.plans.queries import QUERIES
from leadloom.session import build_session

HEADLINE = ("company_trend", "pipeline_funnel", "stage_durations", "customer_rollup", "contract_summary", "normalise_leads",
            "score_leads", "duplicate_summary", "find_duplicate_leads", "write_leads", "write_contracts", "customer_documents", "scan_result",
            "contact_candidates", "key_contacts", "import_report", "page_text", "footer_text", "dedupe_pages", "dedupe_documents",
            "extract_links", "score_links", "crawl_plan", "company_phone", "company_email", "company_industry", "text_units",
            "dedupe_jobs", "tech_from_jobs")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.sql.files.maxPartitionBytes": os.environ.get("BENCH_SPLIT", "4m"),
        "leadloom.input.partitions": cpus})   # the bench tables are files of one row group
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors before the clock
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
