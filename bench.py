"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "flagship_s1_p10_t2",
    "a1_a3_a5_j1_season_panel",
    "j5_a4_starters",
    "a6_a7_p17_category_panel",
    "w4_rolling",
    "m2_m15_ridge_search",
    "m3_out_of_season",
    "m5_m10_m11_m12_screen",
    "m9_elimination",
    "c8_c9_m17_blend",
    "m20_predictors",
]


def main() -> None:
    from panelforge.queries import queries
    from panelforge.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus), **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    known[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
