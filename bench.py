"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores. Arguments
name other queries; ``all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from traymetrics.catalog import QUERIES  # noqa: E402
from traymetrics.session import local_session  # noqa: E402

HEADLINE = [
    "q01_most_wasted",
    "a01_summarize_service",
    "a04_pixel_summary",
    "a05_portion_benchmark",
    "a09_food_rows",
    "a14_daily_pixels",
    "a17_daily_impact",
    "a25_pixel_rollup",
    "g01_assign_pixels",
    "g04_clip_runs",
    "a21_mask_agreement",
    "j09_asof_join",
    "t02_group_dishes",
    "t07_daily_pixels",
    "v15_check_area_answers",
    "w02_counted_attempts",
    "w16_first_per_id",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), scratch=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["w02_counted_attempts"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = folder.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "plate-waste queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
