"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three runs each; one JSON line."""

import json
import os
import re
import time

from mergelens.plans import catalog, reviews  # noqa: F401
from mergelens.session import local_session

HEADLINE = ["group_stats", "distribution_stats", "class_metrics", "roc_auc", "added_lines", "diff_file_map", "file_rollup", "rules_score", "code_census", "flow_features", "similar_topk", "split_assign", "json_ladder", "as_of_history"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    took = {}
    run = lambda name: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("group_stats")  # starts workers and compiles what all queries share
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.time()
            run(name)
            times.append(time.time() - began)
        took[name] = round(sorted(times)[1], 3)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
