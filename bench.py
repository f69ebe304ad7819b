"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = ["normalize_events", "rule_matches_injection", "threat_groups", "chunks_multi_index", "chunk_risk_topk", "actor_batch_stats"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from threatlake.plans import catalog

    found = catalog.queries()
    took = {}
    for name in NAMES:
        for _ in range(2):  # the second, warm run counts
            began = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
            spark.catalog.clearCache()
    print(json.dumps({"metric": "warm seconds, all queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
