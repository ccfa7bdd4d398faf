"""Wall time of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from quarryspark.plans.catalog import QUERIES, Tables
from quarryspark.session import session

HEADLINE = ("tokenize_docs", "index_build", "bm25_topk", "dense_topk", "rrf_hybrid", "simhash_bits", "neardup_pairs", "chunk_stats", "recall_at_k", "search_pipeline", "rate_limit", "domain_cap", "upsert_docs")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        if name == "index_build":  # the whole index; bm25_topk builds that of its own queries, which those after it read too
            Tables(spark, sf_dir).index  # noqa: B018
            took[name] = round(time.time() - began, 3)
            print(name, took[name], file=sys.stderr, flush=True)
            continue
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
