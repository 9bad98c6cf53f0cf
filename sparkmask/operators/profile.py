"""Column profiles: one aggregate per table for all counters and detector rates, then grouped counts where they are needed."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import detectors as det

#: Dates, numbers and texts that stand for "unknown".
DATE_SENTINELS = ["0001-01-01", "1900-01-01", "1899-12-31", "1970-01-01", "9999-12-31"]
NUMBER_SENTINELS = [-1.0, -999.0, 999999999.0, -2147483648.0]
TEXT_SENTINELS = ["n/a", "na", "null", "none", "nil", "tbd", "tba", "todo", "unknown", "unk", "missing", "no data", "n.a.", "?", "-", "--", "...", "x", "xxx", "xxxx", "xxxxx"]
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
#: Cells that a pass of `exact_quantiles` puts values in: to each factor of two in the first pass, to each range in the others.
OCTAVE_CELLS, RANGE_CELLS = 16, 4096


def numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def dated(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def finite(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return c


def counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: column, n, n_null, n_distinct. One scan; distinct counts are exact."""
    columns = columns or df.columns
    aggs = []
    for c in columns:
        aggs += [F.count(F.lit(1)).alias(f"{c}.n"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}.null")]
    base = df.agg(*aggs)
    distinct = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"{c}.d") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}.n`").alias("n"), F.col(f"`{c}.null`").alias("n_null"), F.col(f"`{c}.d`").alias("n_distinct")) for c in columns])
    return base.crossJoin(distinct).select(F.explode(rows).alias("r")).select("r.*")  # one row by one row


def ranked_cells(placed: DataFrame) -> DataFrame:
    """(part, cell, n, lo, hi, before, total): values `x` counted by cell, and the rows of the part in earlier cells and in all."""
    n = placed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = Window.partitionBy("part")  # as many rows as a part has cells
    so_far = w.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select("*", (F.sum("n").over(so_far) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))


def by_part(part: Column, values: list[Column]) -> Column:
    out = F.when(part == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(part == i, v)
    return out


def exact_quantiles(values: DataFrame, probabilities: list[float]) -> list[float | None]:
    """Quantiles of the finite column `x` by linear interpolation; null without rows.

    Each pass counts rows by cell and splits the cells of the wanted ranks further, until each holds one value. The first pass has
    cells by sign and logarithm, so later ones split a range of 2^(1/16) at most and six passes do for any doubles. Tasks hold
    cells, never all distinct values, and the driver gets two cells a quantile at most.
    """
    x, values = F.col("x"), values.where("x is not null").select("x")
    octave = F.signum("x") * (F.floor(F.log2(F.abs(x)) * OCTAVE_CELLS) + 2000 * OCTAVE_CELLS)  # the logarithm of 0 is null
    first = ranked_cells(values.select("x", F.lit(0).alias("part"), F.coalesce(octave, F.lit(0.0)).alias("cell")))
    at = [F.lit(p) * (F.col("total") - 1) for p in probabilities]
    rows = first.where(F.exists(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).collect()
    if not rows:
        return [None] * len(probabilities)
    spots = [p * (rows[0]["total"] - 1) for p in probabilities]
    ranks, found = {f(a) for a in spots for f in (math.floor, math.ceil)}, {}
    parts = [(r["lo"], r["hi"], r["before"], r["n"]) for r in rows]
    while True:
        for lo, hi, before, n in parts:
            if lo == hi:
                found |= {r: lo for r in ranks if before <= r < before + n}
        if not (parts := [p for p in parts if p[0] < p[1]]):
            break
        part = F.coalesce(*[F.when(x.between(lo, hi), i) for i, (lo, hi, *_) in enumerate(parts)])
        cell = by_part(F.col("part"), [F.least(F.floor((x - lo) / (F.lit(hi) - lo) * RANGE_CELLS), F.lit(RANGE_CELLS - 1)) for lo, hi, *_ in parts])
        wanted = by_part(F.col("part"), [F.array(*[F.lit(r - before).cast("long") for r in sorted(ranks) if before <= r < before + n]) for _, _, before, n in parts])
        cells = ranked_cells(values.select("x", part.alias("part")).where("part is not null").select("x", "part", cell.alias("cell")))
        rows = cells.where(F.exists(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).collect()
        parts = [(r["lo"], r["hi"], parts[r["part"]][2] + r["before"], r["n"]) for r in rows]
    return [found[lo] if found[lo] == found[hi] else (hi - a) * found[lo] + (a - lo) * found[hi] for a in spots for lo, hi in [(math.floor(a), math.ceil(a))]]


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, std (sample, 0 for one value), min, max and five quantiles by linear interpolation, which are found at once."""
    c = finite(F.col(column), df.schema[column].dataType).cast("double")
    q = exact_quantiles(df.select(c.alias("x")), QUANTILES)
    out = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.when(F.count(c) > 0, 0.0)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return out.select("*", *[F.lit(v).cast("double").alias(f"p{int(100 * p):02d}") for p, v in zip(QUANTILES, q, strict=True)])


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of equal widths, the last bin closed; a constant column is one bin."""
    c = finite(F.col(column), df.schema[column].dataType).cast("double")
    values = df.select(c.alias("x")).where("x is not null")
    edge = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = values.crossJoin(F.broadcast(edge)).select("lo", "hi", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int").alias("bin"))  # one edge row
    out = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values as text, (value, n), by (-n, value), and the rest as a row of null value if there is one."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    head = n.orderBy(F.col("n").desc(), "value").limit(k)
    total = df.agg(F.count(column).alias("t"))
    rest = head.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("h")).crossJoin(total).where("t > h").select(F.lit(None).cast("string").alias("value"), (F.col("t") - F.col("h")).alias("n"))  # one row by one row
    return head.unionByName(rest)


def crosstab(df: DataFrame, a: str, b: str, k: int = 25) -> DataFrame:
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.col("n").desc(), "a", "b").limit(k)


def year_bins(df: DataFrame, column: str, step: int = 1) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.year(column) / step) * step).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def length_bins(df: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    label = F.when(n < 20, "<20").when(n < 50, "20-50").when(n < 100, "50-100").otherwise(">100")
    return df.where(F.col(column).isNotNull()).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def k_anonymity(df: DataFrame, quasi: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(columns, k, n_groups) of every combination: the size of its smallest group, over rows without nulls in it.

    Rows are first counted by all candidate columns at once; the grouping sets then expand those counts,
    not the rows.
    """
    quasi = quasi[:10]
    base = df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("_n"))
    out = None
    combos = [c for s in sizes for c in combinations(quasi, s)]
    flags = F.array(*[F.struct(F.lit(",".join(c)).alias("columns"), F.when(F.lit(True) if not c else ~F.greatest(*[F.col(x).isNull() for x in c]), F.to_json(F.struct(*[F.col(x).cast("string").alias(f"c{i}") for i, x in enumerate(c)]))).alias("group")) for c in combos])
    rows = base.select("_n", F.explode(flags).alias("s")).select("_n", "s.columns", "s.group").where("group is not null")
    out = rows.groupBy("columns", "group").agg(F.sum("_n").alias("n"))
    return out.groupBy("columns").agg(F.min("n").alias("k"), F.count(F.lit(1)).alias("n_groups"))


def reidentification(k: int) -> float:
    return min(100.0, 100.0 / max(1, k))


def sentinels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, sentinel, n) of values that stand for unknown; one aggregate over all columns."""
    aggs, names = [], []
    for c in columns or df.columns:
        kind, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, T.StringType):
            low = F.lower(F.trim(x))
            tests = [(s, low == s) for s in TEXT_SENTINELS] + [(d, F.substring(F.trim(x), 1, 10) == d) for d in DATE_SENTINELS]
        elif numeric(kind):
            tests = [(str(int(v)), x.cast("double") == v) for v in NUMBER_SENTINELS]
        elif dated(kind):
            tests = [(d, F.date_format(x, "yyyy-MM-dd") == d) for d in DATE_SENTINELS]
        else:
            continue
        for s, test in tests:
            names.append((c, s))
            aggs.append(F.count_if(test).alias(f"s{len(names) - 1}"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("sentinel"), F.col(f"s{i}").alias("n")) for i, (c, s) in enumerate(names)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def detector_rates(df: DataFrame, columns: list[str] | None = None, detectors: list[str] | None = None) -> DataFrame:
    """(column, detector, n, n_match, rate) over non-null values as text; all columns and detectors in one aggregate."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) or numeric(f.dataType)]
    aggs, names = [], []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        for d in detectors or list(det.PATTERNS):
            names.append((c, d))
            aggs += [F.count(text).alias(f"n{len(names) - 1}"), F.count_if(det.matches(text, d)).alias(f"m{len(names) - 1}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("detector"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("n_match")) for i, (c, d) in enumerate(names)])
    out = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("n_match") / F.col("n"), 4)).otherwise(0.0))


def classes(df: DataFrame, column: str) -> DataFrame:
    """One row: casing, alphabet and cardinality classes of a text column."""
    c = F.col(column)
    share = lambda test: F.avg(test.cast("double"))
    row = df.where(c.isNotNull()).agg(F.count(c).alias("n"), F.count_distinct(c).alias("d"), share(c == F.upper(c)).alias("u"), share(c == F.lower(c)).alias("l"), share(c == F.initcap(c)).alias("t"), share(c.rlike(r"^\d+$")).alias("dig"), share(c.rlike("^[A-Za-z]+$")).alias("alp"), share(c.rlike("^[A-Za-z0-9]+$")).alias("aln"))
    casing = F.when(F.col("dig") == 1, "digits").when(F.col("u") == 1, "upper").when(F.col("l") == 1, "lower").when(F.col("t") == 1, "title").otherwise("mixed")
    alphabet = F.when(F.col("dig") == 1, "digits").when(F.col("alp") == 1, "alpha").when(F.col("aln") == 1, "alphanum").otherwise("other")
    card = F.when(F.col("n") == 0, "empty").when(F.col("d") == 1, "constant").when(F.col("d") == F.col("n"), "unique").when(F.col("d") <= 30, "low").otherwise("high")
    return row.select("n", F.col("d").alias("n_distinct"), casing.alias("casing"), alphabet.alias("alphabet"), card.alias("cardinality"))


def run_profile(df: DataFrame, label: str = "source", quasi: list[str] | None = None, extra_hints: dict | None = None, custom: list[det.Custom] = ()) -> dict:
    """The whole profile as a dictionary; what comes to the driver has rows by column, never by value."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    count = {r["column"]: r.asDict() for r in counts(df.select(*plain)).collect()}
    rates: dict[str, dict[str, float]] = {}
    for r in detector_rates(df).collect():
        rates.setdefault(r["column"], {})[r["detector"]] = r["rate"] if r["n"] else 0.0
    if custom:
        row = df.agg(*[F.avg(det.whole(F.trim(F.col(f"`{c}`").cast("string")), d.pattern).cast("double")).alias(f"{c}|{d.detector_id}") for c in rates for d in custom]).first()
        for c in rates:
            for d in custom:
                rates[c][d.detector_id] = row[f"{c}|{d.detector_id}"] or 0.0
    flags: dict[str, list[dict]] = {}
    for r in sentinels(df.select(*plain)).collect():
        flags.setdefault(r["column"], []).append({"sentinel": r["sentinel"], "n": r["n"]})
    out = {"label": label, "n_rows": next(iter(count.values()))["n"] if count else 0, "columns": {}}
    for c in plain:
        found = det.decide(rates.get(c, {}), c, extra_hints, custom)
        out["columns"][c] = {**count[c], "type": df.schema[c].dataType.simpleString(), "detectors": [f.__dict__ for f in found], "sentinels": flags.get(c, []), "strategy": recommend(found[0].detector) if found else None, "pii_score": round(100 * found[0].match_rate) if found else 0}
    if quasi:
        ks = k_anonymity(df, quasi).orderBy("k", "columns").limit(5).collect()
        out["k_anonymity"] = [r.asDict() for r in ks]
        out["reidentification"] = reidentification(ks[0]["k"]) if ks else 0.0
    return out


def recommend(detector: str) -> dict:
    """The strategy that a detector's columns get unless told otherwise."""
    table = {
        "email": ("faker", "person_email"), "person_name": ("faker", "person_name"), "first_name": ("faker", "person_first_name"), "last_name": ("faker", "person_last_name"), "address": ("faker", "address_street"), "us_zip": ("truncate", None), "iso_date": ("date_shift", None), "us_date": ("date_shift", None),
        "eu_date": ("date_shift", None), "ssn": ("fpe", None), "pan": ("fpe", None), "us_phone": ("fpe", None), "npi": ("faker", "synthetic_npi"), "iban": ("faker", "synthetic_iban"), "icd10": ("categorical", None), "cvv": ("redact", None), "biometric_id": ("redact", None),
    }
    strategy, provider = table.get(detector, ("hash", None))
    return {"strategy": strategy, "provider": provider}


def mode_value(df: DataFrame, column: str) -> DataFrame:
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "value").limit(1)


def rank_of_values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The most frequent value of a column within each group."""
    n = df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "value")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
