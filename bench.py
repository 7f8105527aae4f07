"""Time the queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores. A query is evaluated in full
(every column of every row) without a sink. Each query runs once on the smallest tables at hand
first, untimed, so that the figures are about data and not about class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from voltledger.demo.queries import QUERIES  # noqa: E402
from voltledger.session import get_session  # noqa: E402


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    chosen = sys.argv[1:] or list(QUERIES)
    spark = get_session(
        "voltledger-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        **{
            "spark.driver.memory": "16g",
            "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    smallest = Path(sf_dir).parent / "sf0.001"
    if smallest.exists():
        for name in chosen:
            run(spark, name, str(smallest))
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in chosen}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
