"""Time the report queries; prints one JSON line.

Every query writes its whole result to the no-op sink, so all columns and rows
are computed. One untimed query warms the JVM up; then each query runs once,
and its time covers planning as well as execution.
"""

from __future__ import annotations

import json
import os
import sys
import time

from harness.registry import REPORTS
from spendscope.session import build_session

HEADLINE = [
    "q2_enriched_daily", "q3_enriched_monthly", "q4_enriched_campaign", "q5_month_history", "q6_day_detail",
    "q7_range_mean", "q8_range_total", "q9_spu_trend", "q10_spu_skus", "q11_spu_cost_matrix",
    "q12_yearly_summary", "q13_sku_period", "q14_compare_periods", "q15_sku_cost_matrix",
    "q16_campaign_series", "q17_campaigns_in_range", "q18_custom_labels", "q19_spu_register",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REPORTS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("q9_spu_trend")
    seconds = {name: round(min(run(name) for _ in range(repeats)), 3) for name in sys.argv[1:] or HEADLINE}
    print(json.dumps({
        "metric": "report query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
