"""Wall-clock time per query on one machine; prints one JSON line.

``prepare`` is the first use of the input: building each model and the star that the queries share.
It counts in the total. Every query is then run ``BENCH_RUNS`` times in full, all
columns and rows, into Spark's no-op sink, its planning included; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from procflow.plans.order_line_model import order_line_model  # noqa: E402
from procflow.plans.registry import PREPARED, QUERIES  # noqa: E402
from procflow.plans.reports import REPORTS  # noqa: E402
from procflow.session import session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: With copies, the model and the reports also run over so many skewed copies of the order lines.
SKEW_COPIES = int(os.environ.get("BENCH_SKEW_COPIES", "0"))
ONLY = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]


def clock(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def run(spark, query) -> None:
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()


def skewed_copy(spark, copies: int) -> str:
    """``copies`` times the order lines, a sixth of them in one case and a third with one vendor."""
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    many = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "copy"), F.lit(6))
    order = F.when(draw == 0, 1).otherwise(F.col("l_orderkey") + F.col("copy") * 10_000_000)
    target = tempfile.mkdtemp(prefix="procflow-skew-")
    many.select(
        order.cast("long").alias("l_orderkey"),
        "l_partkey",
        F.when(draw < 2, 1).otherwise(F.col("l_suppkey")).cast("long").alias("l_suppkey"),
        F.when(draw == 0, 1).otherwise(F.col("l_linenumber")).cast("int").alias("l_linenumber"),
    ).write.parquet(f"{target}/lineitem.parquet")
    return target


def skewed_run(spark) -> dict:
    """Seconds of the model build and of each report's first run over the skewed copy."""
    folder = skewed_copy(spark, SKEW_COPIES)
    out = {"model": round(clock(lambda: order_line_model(spark, folder)), 3)}
    for name in REPORTS:
        noop = lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        out[name] = round(clock(noop), 3)
    return out


def main() -> None:
    spark = session(
        "procflow-bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = ONLY or list(QUERIES)
    prepare = {name: round(clock(lambda: build(spark, FOLDER)), 3) for name, build in PREPARED.items()}
    first, warm = {}, {}
    for name in names:
        times = [clock(lambda: run(spark, QUERIES[name])) for _ in range(max(RUNS, 1))]
        first[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times), 3)
    total = sum(prepare.values()) + sum(warm.values())
    skew = {"skewed": skewed_run(spark)} if SKEW_COPIES else {}
    print(
        json.dumps(
            {
                "metric": "prepare plus median wall time of all queries",
                "value": round(total, 3),
                "unit": "sec",
                "queries": warm,
                "first_run": first,
                "prepare": prepare,
                "prepare_plus_first_run": round(sum(prepare.values()) + sum(first.values()), 3),
                "sf": Path(FOLDER).name.removeprefix("sf"),
                "cpus": int(CPUS),
                "runs": RUNS,
                "spark": spark.version,
                **skew,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
