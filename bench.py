"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from barloom.plans import CATALOG  # noqa: E402
from barloom.session import local_session  # noqa: E402

HEADLINE = (
    "reversal_top5_vs_universe",
    "bars_from_fills_weekly",
    "fractal_divergence_events",
    "zigzag_divergence_events",
    "events_in_both_pools",
    "cross_divergence_simple",
    "cross_divergence_confirmed",
    "early_turn_events",
    "grid_divergences_as_of_each_day",
    "prefix_event_equality",
    "generated_return",
    "generated_pair_moments",
    "symbol_trend_limit_candle_features",
    "pipeline_advanced_columns",
    "pipeline_cross_section",
    "turnover_and_valuation",
    "market_mood_days",
    "panel_of_bars_basics_limits",
    "sign_labels_two_families",
    "outcome_barrier_exit",
    "daily_rank_ic",
    "segment_score_metrics",
    "tick_windows_by_slice",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="barloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
