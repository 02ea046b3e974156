"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from memstore.operators import ann  # noqa: E402
from memstore.operators import recall as R  # noqa: E402
from memstore.plans import queries as core  # noqa: E402
from memstore.plans.fixtures import NOW, relation  # noqa: E402

HEADLINE = ["search_cosine", "recall_default", "recall_batch", "track_access", "upsert", "compact", "cache_put_latest", "cache_lru", "cache_semantic_hit", "ivf_assign", "centroid_mean", "stats", "list_page"]
#: Timed runs of each; the median counts.
RUNS = 3


def timed(f) -> float:
    """Seconds of the median run, after one that warms up code and workers."""
    f()
    took = []
    for _ in range(RUNS):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return sorted(took)[RUNS // 2]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    times = {q: round(timed(lambda q=q: drain(core.QUERIES[q](spark, sf_dir))), 4) for q in HEADLINE}
    mem = relation(spark, sf_dir, "mem").cache()
    n = mem.count()
    query = core.first_vector(mem)
    times["warm_recall_top10"] = round(timed(lambda: R.recall(mem, R.Request(query), NOW).select("slot", "score").collect()), 4)
    t = time.perf_counter()
    index = ann.train(mem)
    drain(ann.encode(mem, index))
    times["ann_build"] = round(time.perf_counter() - t, 4)
    extra = {"rows": n, "batch_pairs_per_s": round(20 * n / times["recall_batch"])}
    try:
        from memstore.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for q in ("op6_langid", "op8_bpe", "op9_rules", "op10_quality"):
        if q in QUERIES:
            t = time.perf_counter()
            drain(QUERIES[q](spark, sf_dir))
            times[q] = round(time.perf_counter() - t, 4)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"), **extra}))


if __name__ == "__main__":
    main()
