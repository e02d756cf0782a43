"""Time the headline queries and print one JSON line.

Each query is warmed up once, then run three times into a no-op sink; its time is the median. Environment:
BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS, BENCH_QUERIES (comma-separated names or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import comptoir.registry.all  # noqa: E402,F401
from comptoir.registry.base import REGISTRY  # noqa: E402
from comptoir.session import build_session  # noqa: E402

HEADLINE = (
    "A32_par_by_currency", "A19_summary_metrics", "A33_operational_snapshot", "A37_savings_report", "D1_credit_watchlist", "D2_savings_watchlist",
    "A1_ledger_summary", "J6_operations_dataset", "A4_structuring", "A5_unusual_activity", "A7_client_movements", "A40_column_profile",
    "W2_deduplicated", "W3_deletion_suggestions", "C7_text_case", "C9_phones_in_text", "C10_emails_in_text",
    "M1_event_journal", "W1_cumulative_flow", "W7_running_balance", "J9_receipt_ledger_match", "M11_retention", "M12_risk_clients",
    "M14_large_depositors", "M17_client_balance", "M24_period_comparison", "M29_forecast", "Q8_asymmetric_cancellations", "Q16_negative_after_debit",
    "Q18_instalment_status", "Q20_renewals", "Q22_top_decile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else [n for n in HEADLINE if n in REGISTRY]
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in names:
        samples = []
        for i in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 4)
        print(f"{times[name]:8.3f}s {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "median_seconds_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
