"""Time every catalogue query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Arguments: query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

from echoscore.plans.catalog import QUERIES
from echoscore.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["corpus_wer_cer"](spark, sf_dir).limit(1).collect()  # start the JVM's and Python's workers
    times: dict[str, float] = {}
    for name in sys.argv[1:] or list(QUERIES):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "all catalogue queries, each fully evaluated once", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
