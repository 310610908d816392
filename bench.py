"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodemine.plans.queries import REGISTRY
from lodemine.session import build_session

HEADLINE = [
    "review_summary", "top_items", "city_avg_stars", "json_props_sum",
    "son_frequent", "fpgrowth_frequent", "retail_frequent",
    "minhash_signature", "lsh_pairs", "jaccard_pairs",
    "item_pearson", "cf_predict", "features_wide", "hybrid_blend",
    "graph_edges", "label_propagation", "connected_components", "edge_betweenness",
    "bfr_assign", "bfr_rounds",
    "bloom_seen", "bloom_fpr", "fm_estimate", "reservoir_sample", "reservoir_snapshots", "stream_reservoir",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up, not timed
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
