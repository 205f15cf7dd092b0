"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_REPEAT   timed runs per query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from placewise import checks  # noqa: E402
from placewise.session import build_session  # noqa: E402

HEADLINE = [
    "c05_flagship_top_places",
    "c09_score_profiles",
    "a06_zonal_weighted_mean_by_year",
    "a14_resample_bilinear",
    "a17_annual_std",
    "a26_describe_layer",
    "d02_fold_brush",
    "g07_tile_pixel",
    "g15_wkt_centroid",
    "j04_assign_zones",
    "j07_harmonise_names",
    "j20_overzoom",
    "n02_percentile_bytes",
    "p01_gdp_state_tier",
    "p02_calibrate",
    "p05_hazard_lookup",
    "p09_crop_lookup_harvest",
    "p12_masked_layers",
    "p14_hazard_text",
    "p17_hazard_axes",
    "w01_gaussian",
    "w04_top_n_per_cell",
    "w08_dedupe_keys",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(
        f"local[{cpus}]", "placewise-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks.load_all()
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:  # warm-up: JIT, page cache, table schemas
        run(name)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_warm_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
