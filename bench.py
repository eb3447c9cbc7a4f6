"""Times headline queries: one JSON line with seconds per query and their sum.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import workload  # noqa: E402
from lodecat.session import build_session  # noqa: E402

HEADLINE = ["c12_rank", "p3_view_conversion", "c3_infer", "m1_whole_word_join", "h17_relevance", "c1_federated_search", "d8_study_rollup",
            "c4_sample_groups", "c13_bio_rank", "c14_rerank", "u1_upsert", "w3_rank", "x2_review_state", "j5_attach_samples", "d5_topic_availability"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    workload.load_all()
    from workload.scalars import vocabularies
    from workload.text import knowledge
    vocabularies(spark), knowledge(spark)  # read once per session, before the clock starts
    names, seconds = sys.argv[1:] or HEADLINE, {}
    for name in names:
        start = time.perf_counter()
        workload.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
