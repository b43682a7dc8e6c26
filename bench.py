"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from relimpute.plans.suites import all_queries
from relimpute.session import build_session

HEADLINE = [
    "denorm_orders", "inject_orders", "containment_index", "lsh_containment", "meta_paths_by_attr", "path_2hop",
    "path_4hop_lineitem_region", "path_fanout_guard", "candidate_cells", "sample_known_cells", "fk_closure", "entity_row_triples",
    "stype_inference", "numeric_prep", "l2_knn", "candidate_softmax", "path_summary", "vote", "impute_orders", "q_error",
    "eval_report", "rank_metrics_grouped",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["path_1hop"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
