"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from reelquery import catalog
from reelquery.session import session

HEADLINE = ["knn_topk", "knn_topk_native", "image_episode_score", "video_episode_score", "clip_episode_score", "temporal_combined", "episode_rerank_score", "v3_normal", "ocr_episode_score", "fingerprint_fuse", "sequence_rerank", "prototype_score", "subtitle_window", "token_jaccard", "line_window_score", "visual_subtitle_fuse", "asof_nearest_event", "topk_accuracy"]


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spent = {}
    catalog.QUERIES[names[0]](spark, folder).collect()  # starts workers and compiles
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds over the headline queries", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
