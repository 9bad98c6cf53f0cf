"""Synthetic tables: every value is a slice of a digest of (seed, table, column, row), so a row's values don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import MaskError
from ..functions import words
from ..functions.expressions import Translator
from ..functions.identifiers import IDENTIFIERS, modulo
from ..functions.kernel import Kernel, integer_bytes, slice_number, unit, value_list
from .strategies import CDF_STEPS, cdf, identifier

ROW = "_row"


def digest(kernel: Kernel, table: str, column: str, call: int = 0) -> Column:
    return kernel.digest(f"gen/{table}/{column}" + (f"/{call}" if call else ""), integer_bytes(F.col(ROW)))


def sequence(o: dict) -> Column:
    """prefix + zero-filled number + suffix; the fill counts the sign, and longer numbers aren't cut."""
    n = F.lit(int(o.get("start", 1))) + F.col(ROW) * F.lit(int(o.get("step", 1)))
    width, size = int(o.get("pad", o.get("padding", 0)) or 0), F.abs(n).cast("string")
    fill = F.greatest(F.lit(width) - F.length(size) - F.when(n < 0, 1).otherwise(0), F.lit(0))
    return F.concat(F.lit(str(o.get("prefix", ""))), F.when(n < 0, "-").otherwise(""), F.repeat(F.lit("0"), fill), size, F.lit(str(o.get("suffix", ""))))


def by_weight(d: Column, values: list, weights: list[float] | None) -> Column:
    weights = weights or [1.0] * len(values)
    step, out = modulo(d, 0, 8, CDF_STEPS), None
    for bound, v in zip(cdf([float(w) for w in weights]), values, strict=True):
        out = F.when(step < bound, F.lit(v)) if out is None else out.when(step < bound, F.lit(v))
    return out


def faker(d: Column, provider: str, kernel: Kernel, o: dict) -> Column:
    if provider in IDENTIFIERS:
        return identifier(d, provider, o)
    if not words.known(provider):
        raise MaskError("unknown_provider", provider)
    if provider == "random_int_range":
        lo, hi = int(o.get("min", 0)), int(o.get("max", 100))
        return (modulo(d, 0, 8, hi - lo + 1) + lo).cast("long")
    if provider == "random_choice":
        return by_weight(d, list(o["choices"]), o.get("weights"))
    if provider == "uuid":
        return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("4"), F.substring(d, 14, 3)), F.concat(F.lit("a"), F.substring(d, 18, 3)), F.substring(d, 21, 12))
    values = words.pool(provider, int(o.get("pool_size", 2000)), kernel.seed, options=o)
    return F.element_at(value_list(values), (modulo(d, 0, 8, len(values)) + 1).cast("int"))


def from_bins(edges: list[float], counts: list[int], u: Column, v: Column) -> Column:
    """Inverse CDF over bins: u chooses the bin, v the place in it."""
    total, run, out = float(sum(counts)), 0.0, None
    for lo, hi, n in zip(edges, edges[1:], counts, strict=False):
        if not n:
            continue
        run += n
        value = F.lit(float(lo)) + v * F.lit(float(hi - lo))
        out = F.when(u < run / total, value) if out is None else out.when(u < run / total, value)
        last = value
    return out.otherwise(last)


def statistical(entry: dict, d: Column, o: dict, given: tuple[Column, dict] | None = None) -> Column:
    """A draw from one column of a distribution snapshot; given: the conditioning column and its joint cells."""
    kind, s, u, v = entry["kind"], entry["stats"], unit(d), unit(d, 6)
    if given is not None:
        column, cells = given
        out = None
        for key, (values, counts) in cells.items():
            pick = by_weight(d, values, counts)
            out = F.when(column.cast("string") == key, pick) if out is None else out.when(column.cast("string") == key, pick)
        return out
    if kind == "numeric":
        h = s["histogram"]
        edges = [b["low"] for b in h] + [h[-1]["high"]]
        return from_bins(edges, [b["n"] for b in h], u, v)
    if kind == "categorical":
        if not o.get("allow_real_categories", False):
            raise MaskError("statistical_real_categories", "set allow_real_categories to emit the source's values")
        values, counts = [x["value"] for x in s["top_values"]], [x["count"] for x in s["top_values"]]
        if s.get("other_count") and o.get("other_mode", "redistribute") == "emit":
            values, counts = [*values, "OTHER"], [*counts, s["other_count"]]
        return by_weight(d, values, counts)
    if kind == "datetime":
        years = sorted(s["year_bins"].items())
        out, run, total = None, 0, sum(n for _, n in years)
        for y, n in years:
            run += n
            day = F.date_add(F.lit(f"{y}-01-01").cast("date"), F.floor(v * 365).cast("int"))
            out = F.when(u < run / total, day) if out is None else out.when(u < run / total, day)
        return out.otherwise(day)
    if kind == "freetext":
        lo, hi = int(s["min_length"]), int(s["max_length"])
        text = " ".join(words.LOREM) + " "
        n = (F.floor(u * (hi - lo + 1)) + lo).cast("int")
        return F.substring(F.repeat(F.lit(text), hi // len(text) + 2), (F.floor(v * len(text)) + 1).cast("int"), n)
    return F.lit(None).cast("string")


def column(name: str, o: dict, table: str, kernel: Kernel, columns: list[str], snapshots: Callable[[str], dict] | None = None) -> Column:
    """The expression of one generated column; `reference` needs a join and is made in `generate_table`."""
    kind = o.get("type") or o.get("strategy")
    d = digest(kernel, table, name)
    if kind == "sequence":
        out = sequence(o)
    elif kind == "categorical":
        out = by_weight(d, list(o["categories"]), o.get("weights"))
    elif kind == "faker":
        out = faker(d, o.get("provider", ""), kernel, o)
    elif kind == "formula":
        names = {c: F.col(c) for c in columns} | {"i": F.col(ROW), "index": F.col(ROW)}
        out = Translator(names, lambda call: digest(kernel, table, name, call)).translate(o.get("formula") or o["expression"])
    elif kind in ("statistical", "distribution"):
        snap = o["snapshot"] if isinstance(o.get("snapshot"), dict) else snapshots(o["snapshot"])
        source = o.get("column", name)
        given = None
        if on := o.get("condition_on"):
            joint = next((j for j in snap["joints"] if set(j["columns"]) == {on, source}), None)
            if joint is None:
                raise MaskError("statistical_joint_missing", f"{on}, {source}")
            a, b = joint["columns"].index(on), joint["columns"].index(source)
            cells: dict[str, tuple[list, list]] = {}
            for c in joint["cells"]:
                values, counts = cells.setdefault(c["values"][a], ([], []))
                values.append(c["values"][b])
                counts.append(c["count"])
            given = (F.col(on), cells)
        out = statistical(snap["columns"][source], d, o, given)
    else:
        raise MaskError("generate_type_unknown", repr(kind))
    if p := o.get("null_probability"):
        out = F.when(unit(digest(kernel, table, name, 99)) >= float(p), out)
    return out


def reference(df: DataFrame, name: str, o: dict, table: str, kernel: Kernel, parent: DataFrame) -> DataFrame:
    """Parent keys by number: distinct keys are ranked by ranges, a row's number is joined with the rank.

    mode sequential (row mod n), random, or weighted (weights by key); min_per_parent rows at the start go to the
    parents in turn, so that each gets as many; max_per_parent spreads what is beyond over the next parents.
    """
    from .strategies import Context, ranks

    keys = parent.select(F.col(o.get("column", o.get("parent_column"))).alias("_key")).where("_key is not null").distinct()
    ranked = ranks(keys, Context(kernel, name), "_key")
    n = ranked.count()
    if not n:
        raise MaskError("reference_parent_empty", name)
    mode = o.get("mode", "random")
    least, most = int(o.get("min_per_parent", 0)), o.get("max_per_parent")
    rows = df.count() if least or most else 0
    if least * n > rows > 0 or (most is not None and int(most) * n < rows):
        raise MaskError("reference_bounds_impossible", name)
    if mode == "sequential" or most is not None:
        at = F.pmod(F.col(ROW), F.lit(n))
    elif mode == "weighted":
        at = by_weight(digest(kernel, table, name), list(range(n)), [float(w) for w in o["weights"]]).cast("long")
    else:
        at = F.when(F.col(ROW) < least * n, F.pmod(F.col(ROW), F.lit(n))).otherwise(modulo(digest(kernel, table, name), 0, 8, n))
    return df.withColumn("_at", at.cast("long")).join(ranked, F.col("_at") == F.col("_rank"), "left").withColumnRenamed("_key", name).drop("_at", "_rank")


def generate_table(spark: SparkSession, table: str, rows: int, columns: dict[str, dict], kernel: Kernel, parents: dict[str, DataFrame] | None = None, snapshots: Callable[[str], dict] | None = None) -> DataFrame:
    df = spark.range(rows).withColumnRenamed("id", ROW)
    done: list[str] = []
    for name, o in columns.items():
        if (o.get("type") or o.get("strategy")) == "reference":
            df = reference(df, name, o, table, kernel, parents[o["table"]])
        else:
            df = df.withColumn(name, column(name, o, table, kernel, done, snapshots))
        done.append(name)
    return df.select(*done)


def generate_tables(spark: SparkSession, tables: dict[str, dict], kernel: Kernel, sources: dict[str, DataFrame] | None = None, snapshots: Callable[[str], dict] | None = None) -> dict[str, DataFrame]:
    """{table: {rows, columns}} -> DataFrames; tables come after those that they refer to."""
    out, left = dict(sources or {}), dict(tables)
    while left:
        ready = [t for t in left if all(c.get("table") in out or c.get("table") == t for c in left[t]["columns"].values() if (c.get("type") or c.get("strategy")) == "reference")]
        if not ready:
            raise MaskError("fk_cycle", ", ".join(left))
        for t in sorted(ready):
            out[t] = generate_table(spark, t, int(left[t]["rows"]), left.pop(t)["columns"], kernel, out, snapshots)
    return {t: out[t] for t in tables}


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ROW numbers from 0 in the given order within one range-partitioned pass."""
    w = Window.partitionBy("_p").orderBy(*order)
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    starts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # a row per partition
    return parts.withColumn("_r", F.row_number().over(w)).join(F.broadcast(starts), "_p").withColumn(ROW, F.col("_s") + F.col("_r") - 1).drop("_p", "_s", "_r")


def uniform(kernel: Kernel, table: str, name: str) -> Column:
    return slice_number(digest(kernel, table, name), 0, 6)
