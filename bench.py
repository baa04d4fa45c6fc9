"""Times the headline queries on one machine and prints one line of JSON: the median of up to three warm runs each. A query is not begun again once its share of the time is used; each time goes to stderr as it is known."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from reuselens.plans import queries

HEADLINE = ("window_fingerprints", "match_candidates", "match_verified", "match_ranges", "match_lines", "match_coverage", "self_search", "symbol_dictionary", "dedup_exact", "dedup_lines", "html_blocks", "upsert_latest", "new_tags", "scan_progress")
#: Seconds after which a query is not run again.
SHARE = 30


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs, started = [], time.time()
        while len(runs) < 4 and (len(runs) < 2 or time.time() - started < SHARE) and (not runs or runs[0] < SHARE):
            began = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
