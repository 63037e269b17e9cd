"""Headline queries, timed once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from papersieve.catalog import QUERIES  # noqa: E402
from papersieve.session import build_session  # noqa: E402

HEADLINE = (
    "file_scan_outcomes",
    "F1_hashes",
    "F2_entropy",
    "F10_keyword_counts",
    "J3_obfuscation_score",
    "J8_script_budget",
    "U1_classify",
    "U2_sweep",
    "U4_merge",
    "R23_signature_indicators",
    "E6_rounded_score",
    "E9_rationale",
    "T4_fused_summaries",
    "B5_call_admission",
    "H3_latest_finished",
    "H9_orphan_keys",
    "H16_detail",
    "V2_threshold_sweep",
    "V9_top_indicators",
    "P2_redistributed",
    "P12_gate_modes",
    "W8_queue_depth",
    "W10_day_counters",
    "W2_settled_files",
)
WARM_UP = ("F2_entropy", "E6_rounded_score")


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        run(spark, name, folder)
    times = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    files = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "files": files,
                "scan_files_per_second": round(files / times["file_scan_outcomes"], 1),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
