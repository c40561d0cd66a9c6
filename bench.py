"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time
from importlib.util import find_spec

from mdloom.session import local_session
from mdloom.plans.queries import QUERIES

NAMES = ("clean_markdown", "clean_with_audit", "clean_tables_exploded", "table_stats", "md_fields", "clean_documents", "pages_to_markdown", "html_tables", "lost_content", "table_to_markdown", "route_counts")
EXTRA = ("op3_token_counts", "op4_decontamination", "op6_suffix_dedup", "op9_jaccard_join")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = {name: QUERIES[name] for name in NAMES}
    if find_spec("mdloom.llm"):
        from mdloom.llm.queries import QUERIES as more

        queries |= {name: more[name] for name in EXTRA}
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"), shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("OFF")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds = {}
    for name, query in queries.items():
        if os.path.isdir(small):  # a warm-up: what is timed is work on the table, not the start of the JVM and its workers
            query(spark, small).write.format("noop").mode("overwrite").save()
        took = []
        for _ in range(runs):
            start = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        seconds[name] = round(statistics.median(took), 2)
    print(json.dumps({"metric": "sum of query seconds", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
