"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each governed query runs beside the same query over the plain tables; the ratio of
their medians is the overhead of governance. Every run computes all rows and
columns (Spark's noop sink). Each governed query runs once unmeasured, then three times; the
training-data queries run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pactspark.engine import Engine  # noqa: E402
from pactspark.operators.govern import govern  # noqa: E402
from pactspark.policy import DpParam, ResolvedPolicy  # noqa: E402
from pactspark.queries import OUTSIDER, contract  # noqa: E402

REPEATS = 3


def cases(spark: SparkSession, sf: str) -> dict:
    """name: (governed, plain)."""

    class Tables:
        """Both sides open their files anew for each query."""

        def __getitem__(self, name: str) -> DataFrame:
            return spark.read.parquet(f"{sf}/{name}.parquet")

    t = Tables()

    def sql(text: str, *contracts: dict):
        engine = Engine.from_json_contracts(spark, list(contracts))
        return lambda: engine.query(text, OUTSIDER)

    part = 'SELECT * FROM "sales/lineitem/v1"'
    grouped = 'SELECT {0}, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM "sales/lineitem/v1" GROUP BY {0}'
    joined = 'SELECT c.c_name, count(*) AS n, sum(o.o_totalprice) AS total FROM "sales/customer/v1" c JOIN "sales/orders/v1" o ON c.c_custkey = o.o_custkey GROUP BY c.c_name'
    noise = ResolvedPolicy("li", "1", "acme", dp_columns={"l_extendedprice": DpParam(1.0, 0.5), "l_quantity": DpParam(1.0, 0.5)})
    return {
        "filter": (sql(part, contract(sf, "lineitem", None, "l_returnflag = 'R' AND l_quantity > 10")), lambda: t["lineitem"].where("l_returnflag = 'R' AND l_quantity > 10")),
        "mask_string": (sql('SELECT * FROM "sales/customer/v1"', contract(sf, "customer", {"c_name": "hash_sha256"})), lambda: t["customer"]),
        "mask_number": (sql(part, contract(sf, "lineitem", {"l_partkey": "hash_sha256"})), lambda: t["lineitem"]),
        "filter_mask_aggregate": (sql(grouped.format("l_linestatus"), contract(sf, "lineitem", {"l_linestatus": "hash_sha256"}, "l_quantity > 10")), lambda: t["lineitem"].where("l_quantity > 10").groupBy("l_linestatus").agg(F.count("*"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")))),
        "join": (sql(joined, contract(sf, "customer", {"c_name": "hash_sha256"}), contract(sf, "orders", {"o_orderpriority": "partial"}, "o_totalprice > 1000")), lambda: t["customer"].join(t["orders"].where("o_totalprice > 1000"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_name").agg(F.count("*"), F.sum("o_totalprice"))),
        "noise": (lambda: govern(t["lineitem"], noise).df, lambda: t["lineitem"]),
    }


def seconds(make) -> float:
    def once() -> float:
        began = time.perf_counter()
        df: DataFrame = make()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    once()
    return statistics.median(once() for _ in range(REPEATS))


def operators(spark: SparkSession, sf: str) -> dict[str, float]:
    """One run of each training-data query, without a warm-up, where they are installed."""
    try:
        from pactspark.llm import common, queries
    except ModuleNotFoundError:
        return {}
    out = {}
    for name, f in queries.queries().items():
        began = time.perf_counter()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - began, 3)
        common.clean_up(spark)
    return out


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed, overhead = {}, {}
    for name, (governed, plain) in cases(spark, sf).items():
        a, b = seconds(governed), seconds(plain)
        timed[f"governed_{name}"], timed[f"plain_{name}"], overhead[name] = round(a, 4), round(b, 4), round(a / b, 3)
    timed |= operators(spark, sf)
    line = {"metric": "governed query seconds, sum of medians", "value": round(sum(v for k, v in timed.items() if k.startswith("governed_")), 4), "unit": "sec", "queries": timed, "sf": sf, "overhead": overhead, "median_overhead": round(statistics.median(overhead.values()), 3), "cpus": int(cpus), "spark": spark.version, "warm_up": 1, "repeats": REPEATS, "operators_warm_up": 0, "operators_repeats": 1}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
