"""Headline queries, timed warm; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEATS  timed runs per query after one warm-up run (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lotwise import build_session
from lotwise.catalogue import chains, queries
from lotwise.catalogue.chains import CHAIN2, CHAIN4, SEED

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

BROADCAST = (
    "spark.sql.autoBroadcastJoinThreshold",
    "spark.sql.adaptive.autoBroadcastJoinThreshold",
)


def sample(case, n):
    """Memos, draws and the joined sample, with staged tables deleted again."""

    def run(spark):
        chain = case.build(spark, SF_DIR)
        consume(chain.sample(n, SEED))
        chain.release()

    return run


def without_broadcast(run):
    def wrapped(spark):
        for name in BROADCAST:
            spark.conf.set(name, -1)
        try:
            run(spark)
        finally:
            for name in BROADCAST:
                spark.conf.unset(name)

    return wrapped


def registered(name):
    return lambda spark: consume(queries()[name](spark, SF_DIR))


def consume(df):
    df.write.format("noop").mode("overwrite").save()


def full_join(case):
    return lambda spark: consume(case.build(spark, SF_DIR).full_join())


CASES = {
    **{
        name: registered(name)
        for name in (
            "join_cardinality",
            "join_cardinality_chain4",
            "join_cardinality_self",
            "join_cardinality_heavy",
            "join_cardinality_by_site",
            "exact_weights_chain4",
            "tree_cardinality",
            "approx_weights",
            "weighted_sample",
            "sample_per_key",
            "key_filter",
            "site_allocation_drawn",
            "sample_self_join_sliced",
        )
    },
    "sample_chain2_1000": sample(CHAIN2, 1000),
    "sample_chain2_20000": sample(CHAIN2, 20000),
    "sample_chain4_1000": sample(CHAIN4, 1000),
    "sample_chain4_20000": sample(CHAIN4, 20000),
    "sample_chain4_20000_no_broadcast": without_broadcast(sample(CHAIN4, 20000)),
    "full_chain_join2": full_join(CHAIN2),
    "full_chain_join4": full_join(CHAIN4),
    "full_self_join": full_join(chains.SELF_JOIN),
}


def timed(run, spark) -> float:
    start = time.perf_counter()
    run(spark)
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "lotwise-bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, run in CASES.items():
        run(spark)
        seconds[name] = round(
            statistics.median(timed(run, spark) for _ in range(REPEATS)), 3
        )
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of warm medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
