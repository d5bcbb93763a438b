"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Every query is run once to warm up and once
for the record, so indexes that queries share are built before the clock runs; `build_index` builds
one from the raw table each time.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "bm25_all bm25_any phrase prefix near field_filter source_text_search term_stats doc_stats "
    "knn_all knn_label pair_cosine decode_vectors embed_docs semantic_search ulid_to_uuid "
    "front_matter meta_json embed_text ingest_report upsert_two_keys delete_ids lookup_url "
    "list_topics health"
).split()


def main() -> None:
    from shelfmark import registry
    from shelfmark.operators import text_index

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def build_index(spark, sf):
        docs = registry._table(spark, sf, "documents")
        index = text_index.build_index(docs, {"text": F.col("text")}, "doc_id")
        return text_index.write_index(index, tempfile.mkdtemp(prefix="bench-index-") + "/i").doc_stats

    runs = {"build_index": build_index} | {name: registry.queries()[name] for name in HEADLINE}
    if sys.argv[1:]:
        runs = {name: runs[name] for name in sys.argv[1:]}
    seconds = {}
    for name, query in runs.items():
        for _ in range(2):
            start = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
