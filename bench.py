"""Time the headline queries: `BENCH_SF_DIR=... BENCH_CPUS=... python bench.py` prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from contract.queries import QUERIES  # noqa: E402

HEADLINE = [
    "mime_roundtrip", "mail_dossier", "mbox_ordinal", "ics_events", "zip_entries", "xml_messages", "xml_bodies",
    "tag_accounts", "entities_regex", "emails_distinct", "keyword_search", "keyword_boolean", "dossier", "timeline",
    "excerpt", "html_to_text", "processed_anti", "upsert_latest", "first_seen", "body_parts", "attachments_top10",
    "vector_topk", "semantic_text", "csv_roundtrip", "store_batches",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of the headline queries, warm, median of 3",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
