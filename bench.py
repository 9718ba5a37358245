"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("ols_simple", "ols_multi", "ols_hc1", "ols_crv1", "fe_oneway", "fe_twoway", "fe_threeway", "iv_wald", "poisson_fe", "logit_saturated", "dk_panel", "event_study_twfe", "event_study_did2s", "gelbach_point", "quantile_intercept")


def main() -> None:
    from regmesh.plans.registry import queries
    from regmesh.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    found["ols_simple"](spark, sf).collect()  # the first query compiles what all use
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf).collect()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
