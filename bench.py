"""Time the headline queries; prints one JSON line.

Each query is planned, run and written to the no-op sink, so every output column is computed.
``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_QUERIES`` (names).
"""

from __future__ import annotations

import json
import os
import sys
import time

from airgrid.queries import REGISTRY
from airgrid.session import build_session

HEADLINE = [
    "hourly_station_mean", "aqi_rounded", "score_then_average", "unit_parse", "describe", "hour_mode_icon", "latest_per_station",
    "interpolate_time", "winsorize_global", "tiered_impute", "keep_most_complete", "upsert_coalesce", "merge_sources", "rolling_prev",
    "extended_features", "decompose_24", "acf_48", "metrics", "pattern_forecast", "recursive_forecast", "stream_hourly",
    "carry_raw_rows", "stored_upsert", "stored_keep_last", "stream_dedup", "stream_upsert", "station_models",
    "snapshot_upsert", "boosted_station_models", "recursive_profiles", "landed_object_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("airgrid-bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["hourly_station_mean"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
