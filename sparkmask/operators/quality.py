"""Distribution snapshots, and what compares them: diagnostic, fidelity, shape, policy, privacy."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError
from . import profile

SCHEMA = "distribution-snapshot/v1"
GRADES = ((0.95, "A"), (0.85, "B"), (0.70, "C"), (0.50, "D"))


def kind_of(kind: T.DataType, n: int, distinct: int) -> str:
    if n == 0:
        return "empty"
    if isinstance(kind, T.BooleanType):
        return "categorical"
    if profile.numeric(kind):
        return "numeric"
    if profile.dated(kind):
        return "datetime"
    return "categorical" if distinct <= 30 else "freetext"


def snapshot(df: DataFrame, joints: list[tuple[str, str]] = (), k: int = 20) -> dict:
    """The distributions of a table as a dictionary with as many entries as columns and bins."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    count = {r["column"]: r for r in profile.counts(df.select(*[f.name for f in plain])).collect()}
    out = {"schema_version": SCHEMA, "row_count": count[plain[0].name]["n"] if plain else 0, "columns": {}, "joints": []}
    for f in plain:
        c, row = f.name, count[f.name]
        kind = kind_of(f.dataType, row["n"] - row["n_null"], row["n_distinct"])
        entry = {"kind": kind, "null_count": row["n_null"], "distinct_count": row["n_distinct"], "stats": {}}
        if kind == "numeric":
            s = profile.numeric_stats(df, c).first().asDict()
            entry["stats"] = {x: s[x] for x in ("mean", "std", "min", "max")} | {"quantiles": {q: s[q] for q in s if q[0] == "p"}, "histogram": [r.asDict() for r in profile.histogram(df, c).orderBy("bin").collect()]}
        elif kind == "categorical":
            rows = profile.top_values(df, c, k).collect()
            entry["stats"] = {"top_values": [{"value": r["value"], "count": r["n"]} for r in rows if r["value"] is not None], "other_count": sum(r["n"] for r in rows if r["value"] is None)}
        elif kind == "datetime":
            lo, hi = df.agg(F.min(c).cast("string"), F.max(c).cast("string")).first()
            entry["stats"] = {"min": lo, "max": hi, "year_bins": {str(r["year"]): r["n"] for r in profile.year_bins(df, c).collect()}}
        elif kind == "freetext":
            s = df.agg(F.avg(F.length(c)).alias("mean_length"), F.min(F.length(c)).alias("min_length"), F.max(F.length(c)).alias("max_length")).first().asDict()
            entry["stats"] = s | {"length_bins": {r["bucket"]: r["n"] for r in profile.length_bins(df, c).collect()}}
        out["columns"][c] = entry
    for a, b in joints:
        out["joints"].append({"columns": [a, b], "cells": [{"values": [r["a"], r["b"]], "count": r["n"]} for r in profile.crosstab(df, a, b).collect()]})
    return out


def tvd(a: dict, b: dict) -> float | None:
    """Total variation distance of two tables of counts."""
    x, y = sum(a.values()), sum(b.values())
    if not x or not y:
        return None
    return sum(abs(a.get(k, 0) / x - b.get(k, 0) / y) for k in {*a, *b}) / 2


def shares(stats: dict) -> dict:
    return {v["value"]: v["count"] for v in stats.get("top_values", [])} | ({"\0other": stats["other_count"]} if stats.get("other_count") else {})


def similarity(a: dict, b: dict) -> tuple[float | None, str]:
    if a["kind"] != b["kind"]:
        return None, "kind_mismatch"
    x, y = a["stats"], b["stats"]
    if a["kind"] == "numeric":
        span = max(float(x["max"]) - float(x["min"]), 1.0)
        shared = sorted(x["quantiles"].keys() & y["quantiles"].keys())
        error = math.sqrt(sum(((x["quantiles"][q] - y["quantiles"][q]) / span) ** 2 for q in shared) / len(shared))
        return max(0.0, 1.0 - min(1.0, error)), "quantile_rmse"
    if a["kind"] in ("categorical", "datetime"):
        d = tvd(shares(x), shares(y)) if a["kind"] == "categorical" else tvd(x["year_bins"], y["year_bins"])
        return (None if d is None else 1 - d), "tvd"
    if a["kind"] == "freetext":
        return 1 - min(1.0, abs(x["mean_length"] - y["mean_length"]) / max(x["mean_length"], y["mean_length"], 1.0)), "mean_length"
    return None, a["kind"]


def mean(values: list) -> float | None:
    values = [v for v in values if v is not None]
    return round(sum(values) / len(values), 6) if values else None


def fidelity(source: dict, output: dict) -> dict:
    columns = []
    for c in sorted(source["columns"].keys() & output["columns"].keys()):
        s, method = similarity(source["columns"][c], output["columns"][c])
        columns.append({"column": c, "similarity": None if s is None else round(s, 6), "method": method, "comparable": s is not None})
    other = {tuple(j["columns"]): j for j in output["joints"]}
    joints = []
    for j in source["joints"]:
        cells = lambda x: {tuple(c["values"]): c["count"] for c in x["cells"]}
        d = tvd(cells(j), cells(other[tuple(j["columns"])])) if tuple(j["columns"]) in other else None
        joints.append({"columns": j["columns"], "similarity": None if d is None else round(1 - d, 6), "comparable": d is not None})
    marginal, pairwise = mean([c["similarity"] for c in columns]), mean([j["similarity"] for j in joints])
    return {"schema_version": "quality-fidelity/v1", "marginal": {"score": marginal, "columns": columns}, "pairwise": {"score": pairwise, "joints": joints}, "overall_score": mean([marginal, pairwise])}


def shape_fidelity(source: dict, output: dict) -> dict:
    """How alike the profiles of frequencies are, whatever the values are called: TVD of sorted shares."""
    out = []
    for c in sorted(source["columns"].keys() & output["columns"].keys()):
        a, b = source["columns"][c], output["columns"][c]
        if a["kind"] == b["kind"] == "categorical":
            x, y = (dict(enumerate(sorted(shares(s["stats"]).values(), reverse=True))) for s in (a, b))
            d = tvd(x, y)
            out.append({"column": c, "similarity": None if d is None else round(1 - d, 6)})
    return {"columns": out, "score": mean([x["similarity"] for x in out])}


def diagnostic(source: dict, output: dict, drift: float = 0.10) -> dict:
    rate = lambda s, c: s["columns"][c]["null_count"] / max(1, s["row_count"])
    both = sorted(source["columns"].keys() & output["columns"].keys())
    return {
        "missing_columns": sorted(source["columns"].keys() - output["columns"].keys()), "added_columns": sorted(output["columns"].keys() - source["columns"].keys()), "row_parity": source["row_count"] == output["row_count"],
        "kind_drift": [c for c in both if source["columns"][c]["kind"] != output["columns"][c]["kind"]], "null_drift": [c for c in both if abs(rate(source, c) - rate(output, c)) > drift],
    }


def grade(score: float | None) -> str | None:
    return None if score is None else next((g for least, g in GRADES if score >= least), "F")


def report(source: dict, output: dict) -> dict:
    f = fidelity(source, output)
    return {"fidelity": f, "shape": shape_fidelity(source, output), "diagnostic": diagnostic(source, output), "grade": grade(f["overall_score"])}


def apply_policy(result: dict, policy: dict) -> dict:
    """mode report, warn or fail against least scores: {mode, min_overall, min_marginal, columns: {name: least}}."""
    f, bad = result["fidelity"], []
    for key, value in (("min_overall", f["overall_score"]), ("min_marginal", f["marginal"]["score"]), ("min_pairwise", f["pairwise"]["score"])):
        if policy.get(key) is not None and value is not None and value < policy[key]:
            bad.append(f"{key}: {value} < {policy[key]}")
    for c in f["marginal"]["columns"]:
        least = policy.get("columns", {}).get(c["column"])
        if least is not None and c["similarity"] is not None and c["similarity"] < least:
            bad.append(f"{c['column']}: {c['similarity']} < {least}")
    if bad and policy.get("mode") == "fail":
        raise MaskError("quality_policy_failed", "; ".join(bad))
    return {"status": "ok" if not bad else policy.get("mode", "report"), "violations": bad}


def new_rows(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row: how many of output's rows are no rows of source (nulls equal). Source rows are made distinct before they move."""
    columns = [c for c in output.columns if c in source.columns]
    key = lambda df: F.sha1(F.to_json(F.struct(*[df[c].cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}))
    seen = source.select(key(source).alias("_k")).distinct().withColumn("_seen", F.lit(1))
    out = output.select(key(output).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("n")).join(seen, "_k", "left")
    return out.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_seen").isNull(), F.col("n"))), F.lit(0)).alias("n_new")).withColumn("new_rate", F.round(F.col("n_new") / F.col("n_rows"), 6))


def nearest(source: DataFrame, output: DataFrame, numeric: list[str], categorical: list[str] = (), cap: int | None = 5000, key: str | None = None) -> DataFrame:
    """Each sampled output row's least mean Gower distance to the sampled source rows: (key, distance).

    Both sides are samples of `cap` rows at most (the metric's definition); the source's is broadcast. Without a cap,
    all rows are compared, by sorted neighbours; that takes one numeric column at most.
    """
    if cap is None:
        return nearest_of_all(source, output, numeric, categorical, key)
    sample = lambda df: df.orderBy(F.xxhash64(*[df[c] for c in [*numeric, *categorical]])).limit(cap)
    span = source.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"_r{i}") for i, c in enumerate(numeric)]) if numeric else None
    s = sample(source).select(*[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(numeric)], *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(categorical)])
    o = sample(output).withColumn("_id", F.col(key) if key else F.monotonically_increasing_id())
    both = o.crossJoin(F.broadcast(s))  # cap x cap rows at most
    if span is not None:
        both = both.crossJoin(F.broadcast(span))
    parts = [F.when(F.col(f"_r{i}") > 0, F.least(F.abs(F.col(c).cast("double") - F.col(f"_s{i}")) / F.col(f"_r{i}"), F.lit(1.0))).otherwise(F.when(F.col(c).cast("double") == F.col(f"_s{i}"), 0.0).otherwise(1.0)) for i, c in enumerate(numeric)]
    parts += [F.when(F.col(c).cast("string").eqNullSafe(F.col(f"_c{i}")), 0.0).otherwise(1.0) for i, c in enumerate(categorical)]
    return both.groupBy("_id").agg(F.min(sum(parts[1:], parts[0]) / len(parts)).alias("distance")).withColumnRenamed("_id", key or "row")


def nearest_of_all(source: DataFrame, output: DataFrame, numeric: list[str], categorical: list[str] = (), key: str | None = None, rows: int = 100_000) -> DataFrame:
    """nearest() of all rows. For each set of categories that may have to agree, the nearest number is a neighbour in sort order.

    Numbers are sorted in buckets of about `rows` distinct rows; a bucket knows the nearest source numbers of those beside it.
    """
    if len(numeric) > 1:
        raise MaskError("nearest_needs_cap", f"{len(numeric)} numeric columns")
    value = lambda df: F.nanvl(df[numeric[0]].cast("double"), F.lit(None).cast("double")) if numeric else F.lit(None).cast("double")
    combined = lambda df: df.withColumn("_v", value(df)).withColumn("_o", F.to_json(F.struct(*[df[c].cast("string").alias(f"c{i}") for i, c in enumerate(categorical)], F.col("_v").alias("v")), {"ignoreNullFields": "false"}))
    group = lambda mask: F.to_json(F.struct(F.lit(mask).alias("m"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical) if mask >> i & 1]), {"ignoreNullFields": "false"})
    ids = combined(output).withColumn("_id", F.col(key) if key else F.monotonically_increasing_id())
    masks = range(2 ** len(categorical))
    sets = F.explode(F.array(*[F.struct(group(m).alias("g"), F.lit(len(categorical) - m.bit_count()).alias("apart")) for m in masks])).alias("s")
    src = combined(source).select("_v", sets).select(F.lit(None).cast("string").alias("_o"), "_v", "s.*").distinct()
    out = ids.select("_o", "_v", sets).select("_o", "_v", "s.*").distinct()
    both = src.withColumn("_src", F.lit(1)).unionByName(out.withColumn("_src", F.lit(0)))
    buckets = min(1000, -(-both.count() // rows))
    cuts = both.approxQuantile("_v", [i / buckets for i in range(1, buckets)], 0.001) if buckets > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("_v"))) if cuts else F.lit(0)
    both = both.withColumn("_b", F.when(F.col("_v").isNull(), -1).otherwise(bucket))
    theirs = F.when(F.col("_src") == 1, F.col("_v"))
    order, ends = Window.partitionBy("g", "_b").orderBy("_v"), Window.partitionBy("g").orderBy("_b")
    near = both.withColumn("_p", F.last(theirs, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first(theirs, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    edges = both.groupBy("g", "_b").agg(F.min(theirs).alias("lo"), F.max(theirs).alias("hi"), F.max("_src").alias("_any"))
    edges = edges.select("g", "_b", F.max("hi").over(ends.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.min("lo").over(ends.rowsBetween(1, Window.unboundedFollowing)).alias("_above"), F.max("_any").over(Window.partitionBy("g")).alias("_any"))
    found = near.where("_src = 0").join(edges, ["g", "_b"]).where("_any = 1")
    if numeric:
        found = found.crossJoin(F.broadcast(source.agg((F.max(numeric[0]) - F.min(numeric[0])).cast("double").alias("_r"))))
        least = F.least(*[F.abs(F.col("_v") - F.col(c)) for c in ("_p", "_n", "_below", "_above")])
        part = F.when(F.col("_r") > 0, F.least(least / F.col("_r"), F.lit(1.0))).otherwise(F.when(least == 0, 0.0).otherwise(1.0))
    else:
        part = F.lit(0.0)
    best = found.groupBy("_o").agg(F.min((part + F.col("apart")) / (len(numeric) + len(categorical))).alias("distance"))
    return ids.join(best, "_o").groupBy("_id").agg(F.min("distance").alias("distance")).withColumnRenamed("_id", key or "row")


def dp_noise(snap: dict, epsilon: float, seed: int | None = None) -> dict:
    """A snapshot with Laplace noise on its counts; quantiles are removed, joints refused."""
    if epsilon <= 0:
        raise MaskError("dp_epsilon_invalid", str(epsilon))
    if snap.get("joints"):
        raise MaskError("dp_joints_unsupported")
    rng = random.Random(seed) if seed is not None else random.SystemRandom()
    noisy = lambda n: max(0, round(n + rng.expovariate(epsilon) - rng.expovariate(epsilon)))
    out = {**snap, "row_count": noisy(snap["row_count"]), "columns": {}}
    for c, e in snap["columns"].items():
        s = {k: v for k, v in e["stats"].items() if k not in ("quantiles", "min", "max", "mean", "std")}
        if "top_values" in s:
            s["top_values"] = [{**v, "count": noisy(v["count"])} for v in s["top_values"]]
        for k in ("year_bins", "length_bins"):
            if k in s:
                s[k] = {x: noisy(n) for x, n in s[k].items()}
        if "histogram" in s:
            s["histogram"] = [{**b, "n": noisy(b["n"])} for b in s["histogram"]]
        out["columns"][c] = {**e, "null_count": noisy(e["null_count"]), "distinct_count": noisy(e["distinct_count"]), "stats": s}
    return out
