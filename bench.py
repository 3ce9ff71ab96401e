"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_REPEAT  timed repetitions after a warm-up, the median counts (default 1; whole runs have no warm-up)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from tallyfold import run
from tallyfold.session import local_session, work_dir
from workloads import tables as t
from workloads.spark_queries import QUERIES

RUNS = ("gated_run", "gated_run_report", "csv_roundtrip", "csv_defects", "column_conformance", "decimal_comma",
        "quoted_line_breaks", "many_headers", "wide_records", "mixed_formats", "split_row_numbers", "name_forms", "run_modes",
        "republish", "partitioned_run", "sums_of_any_size", "validated_tables")


def timed(action, repeat: int) -> float:
    seconds = []
    for _ in range(repeat):
        started = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - started)
    return round(statistics.median(seconds), 3)


def split_lists(spark, folder: str, n: int) -> str:
    """The same lineitem rows as ``n`` delimited lists."""
    rows = t.table(spark, folder, "lineitem").select(*t.PART_QUANTITY.required)
    return t.csv_folder(spark, [rows.repartition(n)])


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, repeat = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEAT", "1"))
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    rows = t.table(spark, folder, "lineitem").count()

    def noop(name):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    noop("consolidate_sum")  # warm-up of JVM and file cache
    for name in QUERIES:
        if name not in RUNS:
            noop(name)
        seconds[name] = timed(lambda: noop(name), 1 if name in RUNS else repeat)
        print(f"{name}: {seconds[name]}", file=sys.stderr)

    # The whole job against its own core, and the same rows in ever more lists.
    plain, gated = {}, {}
    for n in (7, 84, 1000):
        path = split_lists(spark, folder, n)
        gated[n] = timed(lambda: run(spark, t.PART_QUANTITY, path, work_dir(spark, "out") + "/result"), 1)
        plain[n] = timed(lambda: (
            spark.read.options(sep=";", header=True).schema("l_partkey bigint, l_linestatus string, l_quantity double")
            .csv(path).groupBy("l_partkey", "l_linestatus").agg(F.sum("l_quantity"))
            .write.format("noop").mode("overwrite").save()), 1)
        seconds[f"full_run_{n}_lists"] = gated[n]
        print(f"{n} lists: full run {gated[n]}, bare group-by {plain[n]}", file=sys.stderr)

    print(json.dumps({
        "metric": "total seconds of all queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "lineitem_rows": rows,
        "rows_per_sec_consolidate_sum": round(rows / seconds["consolidate_sum"]),
        "bare_csv_group_by": {f"{n}_lists": s for n, s in plain.items()}}))


if __name__ == "__main__":
    main()
