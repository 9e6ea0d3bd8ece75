"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The cube is prepared first (its time is ``prepare``). Each query runs once to warm up and then three
times, all queries in a new order each time; its time is the mean without the slowest and the fastest
run. The value is the sum over all queries. ``outputs`` times the flights up to their pandas
cross-tabs."""

from __future__ import annotations

import json
import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FLIGHTS = [f"q{a}{b}" for a, n in ((1, 3), (2, 3), (3, 4), (4, 3)) for b in range(1, n + 1)]
HEADLINE = FLIGHTS + [
    "total_no_axes", "one_axis_supplier_region", "one_axis_supplier_nation", "two_axes_region_brand", "two_axes_two_measures",
    "three_axes_nation_brand_region", "five_axes_role_dates", "pivot_year_by_brand", "rollup_month_to_year",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from latticework import queries

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    began = time.perf_counter()
    cube = queries._sales(spark, path)
    prepared = time.perf_counter() - began
    jobs = {n: lambda n=n: queries.QUERIES[n](spark, path).write.format("noop").mode("overwrite").save() for n in names}
    jobs |= {f"output:{n}": lambda n=n: queries.VIEWS[n][0](cube).output() for n in names if n in FLIGHTS}
    took: dict[str, list[float]] = {n: [] for n in jobs}
    order, rng = list(jobs), random.Random(1)
    for k in range(runs + 1):
        rng.shuffle(order)
        for n in order:
            began = time.perf_counter()
            jobs[n]()
            if k:
                took[n].append(time.perf_counter() - began)
    mean = lambda x: round(sum(x) / len(x), 4)
    times = {n: mean(sorted(x)[1:-1] if runs > 2 else x) for n, x in took.items()}
    outputs = {n.removeprefix("output:"): times.pop(n) for n in list(times) if n.startswith("output:")}
    print(json.dumps({"metric": "warm seconds over the cube's headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(path).removeprefix("sf"), "prepare": round(prepared, 3), "outputs": outputs}))
    spark.stop()


if __name__ == "__main__":
    main()
