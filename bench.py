"""Wall time of the headline queries; prints one JSON line.

Every query runs whole, including the stage tables it writes. The result is
drained without being collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from eventide.plans.catalogue import QUERIES
from eventide.session import local_session

HEADLINE = [
    "daily_bars", "dense_grid", "sector_index", "event_trajectory", "trajectory_wide", "training_frame",
    "event_feature_join", "volume_backfill", "item_betas", "tier_picks", "seasonality", "excess_return",
    "hourly_deviation", "best_hours", "walk_forward", "directional_accuracy", "backtest_last_event",
    "scenario_scores", "post_score", "best_post", "recent_context", "target_item_filter", "page_text",
    "notice_upsert", "json_landing", "board_year", "final_overwrite", "forecast_choice", "stream_upsert", "stream_alerts",
    "walk_forward_lines", "backtest_features", "isotonic_fit", "tick_store",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["daily_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
