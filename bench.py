"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line.

Masks run over lineitem and orders, one strategy each, to the `noop` sink: every row is computed and
nothing is collected. The value is the total of the queries' best of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def mask(strategy: str, column: str, table: str = "lineitem", key: str | None = None, **more):
    """One column of a table masked, as the published per-strategy figures have it."""

    def run(spark):
        from sparkmask.plans.run import run_pipeline

        df = spark.read.parquet(f"{SF}/{table}.parquet")
        columns = list(dict.fromkeys([column, *([key] if key else [])]))
        df = df.select(*[df[c].cast("string").alias(c) if c == column and more.get("as_text") else df[c] for c in columns])
        spec = {"name": column, "strategy": strategy, "namespace": "bench"} | {k: v for k, v in more.items() if k != "as_text"}
        config = {"global_settings": {"seed": 1}, "tables": {table: {"columns": [spec], "row_key": [key] if key else []}}}
        return run_pipeline(spark, config, {table: df}).tables[table]

    return run


def catalogue(name: str):
    def run(spark):
        from sparkmask.queries import QUERIES

        return QUERIES[name](spark, SF)

    return run


BENCH = {
    "mask_passthrough": mask("passthrough", "l_orderkey"),
    "mask_redact": mask("redact", "l_returnflag"),
    "mask_truncate": mask("truncate", "l_shipdate", as_text=True, provider_config={"length": 4}),
    "mask_faker": mask("faker", "l_orderkey", provider="person_full_name"),
    "mask_date_shift": mask("date_shift", "l_shipdate", as_text=True, provider_config={"date_format": "%Y-%m-%d %H:%M:%S"}),
    "mask_bucketize": mask("bucketize", "l_quantity", provider_config={"width": 10}),
    "mask_hash": mask("hash", "l_orderkey"),
    "mask_categorical": mask("categorical", "l_orderkey", provider_config={"categories": ["a", "b", "c"], "weights": [5, 3, 2]}),
    "mask_formula": mask("formula", "l_extendedprice", provider_config={"formula": "round(value * 1.1, 2)"}),
    "mask_shuffle": mask("shuffle", "o_orderstatus", "orders", "o_orderkey"),
    "mask_fpe": mask("fpe", "o_orderkey", "orders"),
    **{q: catalogue(q) for q in ("flagship", "fk_preserve_orders", "fk_remap_orders", "transform_filter_derive", "transform_dedupe", "discovery_aggregate", "discovery_join_inner", "discovery_window_rank", "quantiles", "k_anonymity", "leakage", "text_redact_all")},
}


def main() -> None:
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = {}
    for name, run in BENCH.items():
        best = None
        for _ in range(2):
            began = time.perf_counter()
            run(spark).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - began)
        queries[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
