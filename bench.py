"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Seconds are the median of three runs after one that warms up.  Operations on the store run on fresh
stores each time; what only prepares them is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lodestrata.model import events_log, key_of
    from lodestrata.operators import versions as V
    from lodestrata.plans.queries import QUERIES
    from lodestrata.sources.commits import scratch
    from lodestrata.sources.store import Options, Store

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    log = events_log(spark, SF_DIR)
    n = log.count()
    third = [log.filter(F.expr(f"seq % 3 = {i}")) for i in range(3)]
    keys = spark.read.parquet(f"{SF_DIR}/customer.parquet").select(key_of("c_custkey").alias("key")).limit(10_000)

    def done(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def new_store(filled: int = 0, flushed: bool = False) -> Store:
        store = Store.open(spark, scratch(spark, "bench"), Options(payload="event_type string, value double"))
        for batch in third[:filled]:
            store.write(batch)
            if flushed:
                store.flush()
        return store

    def timed(action, prepare=lambda: None) -> float:
        seconds = []
        for _ in range(RUNS + 1):
            subject = prepare()
            began = time.perf_counter()
            action(subject)
            seconds.append(time.perf_counter() - began)
        return round(median(seconds[1:]), 4)

    found = {
        "write_batch": timed(lambda s: s.write(log), new_store),
        "flush": timed(lambda s: s.flush(), lambda: new_store(3)),
        "compact": timed(lambda s: s.compact(), lambda: new_store(3, True)),
        "recover": timed(lambda s: Store.open(spark, s.path).live().count(), lambda: new_store(3)),
        "latest": timed(lambda _: done(V.live(log))),
        "ordered_scan": timed(lambda s: done(s.scan()), lambda: new_store(3, True)),
        "range_scan": timed(lambda s: done(s.scan("0000000100", "0000000115")), lambda: new_store(3, True)),
        "prefix_scan": timed(lambda s: done(s.prefix_scan("00000001")), lambda: new_store(3, True)),
        "point_get": timed(lambda s: s.get("0000000007"), lambda: new_store(3, True)),
        "multi_get_10k": timed(lambda s: done(s.multi_get(keys)), lambda: new_store(3, True)),
    }
    for name in ("scan_forward", "multi_get", "kway_merge", "compact_merge", "tombstone_gc", "lineitem_latest", "seq_assign"):
        found[name] = timed(lambda _, q=QUERIES[name]: done(q(spark, SF_DIR)))
    total = round(sum(found.values()), 4)
    print(json.dumps({"metric": "median seconds of all headline queries together", "value": total, "unit": "sec", "queries": found, "sf": SF_DIR, "mutations": n, "rows_per_sec": {k: round(n / found[k]) for k in ("write_batch", "latest", "compact", "ordered_scan")}}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
