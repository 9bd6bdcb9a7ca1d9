"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each time covers building the
plan (with its staged parts) and computing every output row. Every query first runs once, outside the
clock, on the smallest tables beside the folder, where there are any, so that no query bears the start of the others.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventcast import catalog  # noqa: E402
from eventcast.session import build_session, drop_scratch  # noqa: E402

HEADLINES = [
    "b11_clean_data", "w_engineer_features", "w1_days_since_last", "w2_event_frequency",
    "w5_global_lags", "d1_daily_counts", "d2_weekly_counts", "d6_weekly_panel", "d10_describe_price",
    "d13_box_stats", "d14_correlation", "t2_text_stats", "t6_process_text", "e1_sequences",
    "e6_label_codes", "e8_apply_encoding", "e16_chronological_split", "x1_global_rank",
    "g1_seasonal_naive", "g2_moving_average", "g5_lagged_forecast", "g7_sarima", "g8_all_baselines",
    "h1_score", "h18_class_report", "n2_edges", "n4_degree", "n6_induced_subgraph", "n9_propagate_3",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    smallest = Path(folder).parent / "sf0.001"
    seconds = {}
    for name in names:
        if smallest.is_dir():
            registered[name](spark, str(smallest)).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    drop_scratch(spark)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
