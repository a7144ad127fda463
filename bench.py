"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to its last row (noop sink). The shared artifacts (clean catalog,
quality table, neighbors, masked requests) are built under their own names first, as the
batch job would, and then read by the request queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from stallrec.registry.queries import QUERIES, parts

HEADLINE = (
    "feedback_user_item",
    "feedback_orders",
    "catalog_listing",
    "quality_ranked",
    "user_preferences",
    "neighbors_50",
    "vector_neighbors_euclidean",
    "similar_items",
    "prefiltered_items",
    "family_first",
    "content_mixed",
    "mixed_interleaved",
    "relaxed_quality",
    "buyer_quality_slugs",
    "collaborative_top",
    "collaborative_randomised",
    "reranked",
    "precision_at_100",
    "auc_score",
    "export_interactions",
    "batch_answers",
    "collaborative_model_job",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    shared = parts(spark, sf_dir)
    for name in ("items", "quality", "neighbors", "requests"):
        timed(f"artifact_{name}", lambda: getattr(shared, name))
    for name in HEADLINE:
        if not only or name in only:
            timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
