"""Headline queries on one machine: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dialwise.plans.catalogue import QUERIES  # noqa: E402
from dialwise.session import local_session  # noqa: E402

HEADLINE = [
    "explode_appearances",
    "attribute_system",
    "events_roundtrip",
    "rates_system",
    "rates_system_compare",
    "rates_age",
    "system_ranking",
    "ddd_bonus",
    "half_life",
    "score_phones",
    "top2_phones",
    "cpfs_multi",
    "sample_size",
    "bootstrap_rate_diff",
    "ab_primary",
]
RUNS = 2


def seconds(spark, sf_dir: str, name: str) -> float:
    """Time to plan the query and compute every row and column of its result."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "dialwise-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The best of the runs, so that starting the JVM does not count against the first query.
    times = {n: min(seconds(spark, sf_dir, n) for _ in range(RUNS)) for n in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
