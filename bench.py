"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loamline.session import local_session
from verification import base, registry  # noqa: F401

HEADLINE = (
    "e2_daily_water_content",
    "e7_treatment_comparison",
    "d3_season_by_expression",
    "d3_season_by_calendar_join",
    "d3_season_by_range_join",
    "d4_pair_by_place_and_day",
    "d10_nearest_grid_point",
    "e15_exact_quantiles",
    "e15_exact_quantiles_by_bin",
    "e15_exact_quantiles_by_rank",
    "f4_shortest_interval_by_rank",
    "k1_grid_sse",
    "k5_zoomed_fit",
    "m2_lookup_quantiles",
    "m5_convert",
    "n1_seasonal_water_content",
    "n6_curve_input",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        base.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
