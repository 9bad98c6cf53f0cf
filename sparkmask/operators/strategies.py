"""Mask strategies: each turns a column into an expression over it; a table is masked by one select.

A strategy gets the column, its type and a Context (kernel, namespace, options) and returns a Column. Nulls
stay null. Strategies that need a number from the data (date formats, cardinality modes, shuffles) say
so in `plans.run`, which gives it to them; all others are pure functions of the value, so they run as well
on a stream and don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError
from ..functions import fpe as fpes
from ..functions import words
from ..functions.expressions import Translator, java_format
from ..functions.identifiers import IDENTIFIERS
from ..functions.kernel import Kernel, canonical_column, index_of, slice_number, value_list

#: Weighted categories are resolved to this many equal steps.
CDF_STEPS = 1_000_000
#: Presets of bucketize.
PRESETS = {"by_year": 1, "by_2_years": 2, "by_5_years": 5, "by_decade": 10, "by_century": 100, "by_thousand": 1000, "by_ten_thousand": 10_000}
#: Date formats that are tried in this order.
DATE_FORMATS = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y", "%Y%m%d", "%m/%d/%y", "%d/%m/%y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"]


@dataclass
class Context:
    kernel: Kernel
    column: str
    namespace: str | None = None
    options: dict = field(default_factory=dict)
    deterministic: bool = True
    provider: str | None = None
    nfc: bool = False
    pool_size: int = 10_000
    row_key: Column | None = None
    columns: tuple[str, ...] = ()
    inner: dict[str, Column] | None = None

    def digest(self, column: Column, kind: T.DataType) -> Column:
        if self.namespace is None:
            raise MaskError("deterministic_namespace_missing", self.column)
        out = self.kernel.digest(self.namespace, canonical_column(column, kind, bool(self.options.get("assume_utc")), self.nfc))
        if self.inner is None:
            return out
        name = f"_digest_{len(self.inner)}"  # made in an inner projection, so that what slices it twice computes it once
        self.inner[name] = out
        return F.col(name)

    def row_draw(self, call: int = 0) -> Column:
        """A digest of the row's key: what non-deterministic draws use instead of a generator with state."""
        key = self.row_key if self.row_key is not None else F.monotonically_increasing_id()
        return self.kernel.digest(f"row/{self.column}/{call}", key.cast("string").cast("binary"))


def keep_null(source: Column, out: Column) -> Column:
    return F.when(source.isNotNull(), out)


def passthrough(c: Column, kind: T.DataType, ctx: Context) -> Column:
    return c


def redact(c: Column, kind: T.DataType, ctx: Context) -> Column:
    return keep_null(c, F.lit(str(ctx.options.get("redact_with", "REDACTED"))))


def truncate(c: Column, kind: T.DataType, ctx: Context) -> Column:
    o = ctx.options
    length = o.get("length")
    if not isinstance(length, int) or isinstance(length, bool) or length < 1:
        return c
    text = c.cast("string")
    tail = o.get("keep", "tail" if o.get("from_end") else "head") == "tail"
    kept = F.right(text, F.lit(length)) if tail else F.left(text, F.lit(length))
    mask = o.get("mask_char")
    if not isinstance(mask, str) or len(mask) != 1:
        return kept
    fill = F.repeat(F.lit(mask), F.greatest(F.length(text) - length, F.lit(0)))
    return F.concat(fill, kept) if tail else F.concat(kept, fill)


def python_float(c: Column) -> Column:
    """A double as Python prints it, for the magnitudes that print without an exponent."""
    whole = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e16), whole).otherwise(c.cast("string"))


def bucketize(c: Column, kind: T.DataType, ctx: Context) -> Column:
    o = ctx.options
    width = PRESETS.get(o["preset"]) if o.get("preset") is not None else o.get("width")
    if isinstance(width, bool) or not isinstance(width, int | float) or width <= 0:
        return c
    style = str(o.get("format", "lower")).lower()
    n = c.cast("string").try_cast("double") if isinstance(kind, T.StringType) else c.cast("double")
    n = F.when(~F.isnan(n), n)
    low = F.floor(n / F.lit(float(width))) * F.lit(float(width))
    if isinstance(width, int):
        text = lambda x: x.cast("long").cast("string")
        high = low + (width - 1)
    else:
        text, high = python_float, low + width
    if style == "range":
        out = F.concat(text(low), F.lit("-"), text(high))
    elif style == "midpoint":
        mid = low + F.lit(width / 2)
        out = text(mid) if isinstance(width, int) and width % 2 == 0 else python_float(mid)
    else:
        out = text(low)
    return F.coalesce(out, c.cast("string"))


def hash_(c: Column, kind: T.DataType, ctx: Context) -> Column:
    digest = ctx.digest(c, kind)
    n = ctx.options.get("truncate")
    return F.substring(digest, 1, n) if isinstance(n, int) and n > 0 else digest


def cdf(weights: list[float]) -> list[int]:
    if any(w < 0 for w in weights):
        raise MaskError("categorical_weights_negative")
    total = float(sum(weights))
    if total <= 0:
        raise MaskError("categorical_weights_nonpositive")
    if any(0 < w / total * CDF_STEPS < 1 for w in weights):
        raise MaskError("categorical_weight_below_resolution")
    run, out = 0.0, []
    for w in weights:
        run += w
        out.append(round(run / total * CDF_STEPS))
    return [*out[:-1], CDF_STEPS]


def pick(index: Column, values: list) -> Column:
    return F.element_at(value_list(values), (index + 1).cast("int"))


def weighted(step: Column, values: list, weights: list[float]) -> Column:
    """The first value whose cumulated weight is beyond the step (0 .. CDF_STEPS - 1)."""
    out = None
    for bound, v in zip(cdf(weights), values, strict=True):
        out = F.when(step < bound, F.lit(v)) if out is None else out.when(step < bound, F.lit(v))
    return out


def categorical(c: Column, kind: T.DataType, ctx: Context) -> Column:
    values, weights = list(ctx.options.get("categories") or []), ctx.options.get("weights")
    if not values:
        raise MaskError("categorical_empty", ctx.column)
    if weights is not None and len(weights) != len(values):
        raise MaskError("categorical_weights_shape", ctx.column)
    if ctx.deterministic and ctx.namespace is None:
        raise MaskError("categorical_requires_namespace", ctx.column)
    digest = ctx.digest(c, kind) if ctx.deterministic else ctx.row_draw()
    out = pick(index_of(digest, len(values)), values) if weights is None else weighted(index_of(digest, CDF_STEPS), values, [float(w) for w in weights])
    return keep_null(c, out)


def detect_format(df: DataFrame, column: str, rows: int = 200) -> str | None:
    """The first format that all of the first `rows` values parse by; one small aggregate."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return None
    sample = df.select(F.trim(column).alias("v")).where("v is not null").limit(rows)
    row = sample.agg(F.count("v").alias("n"), *[F.count(parse(F.col("v"), f)).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]).first()
    return next((f for i, f in enumerate(DATE_FORMATS) if row["n"] and row[f"f{i}"] == row["n"]), None)


def parse(text: Column, strftime: str) -> Column:
    """A text as a timestamp without zone, null if it isn't of the format. One- and two-digit months and days both parse."""
    loose = java_format(strftime)
    if strftime != "%Y%m%d":
        loose = loose.replace("MM", "M").replace("dd", "d")
    return F.when(text.rlike(shape(strftime)), F.try_to_timestamp(text, F.lit(loose)))


def shape(strftime: str) -> str:
    out = strftime.replace(".", r"\.")
    fixed = strftime == "%Y%m%d"
    for k, v in (("%Y", r"\d{4}"), ("%y", r"\d{2}"), ("%H", r"\d{1,2}"), ("%M", r"\d{1,2}"), ("%S", r"\d{1,2}"), ("%m", r"\d{2}" if fixed else r"\d{1,2}"), ("%d", r"\d{2}" if fixed else r"\d{1,2}")):
        out = out.replace(k, v)
    return f"^{out}$"


def date_shift(c: Column, kind: T.DataType, ctx: Context) -> Column:
    o = ctx.options
    if "jitter_days" in o:
        lo, hi = -abs(int(o["jitter_days"])), abs(int(o["jitter_days"]))
    else:
        lo, hi = sorted((int(o.get("min_days", -365)), int(o.get("max_days", 365))))
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd") if isinstance(kind, T.DateType) else F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        days = (index_of(ctx.digest(text, T.StringType()), hi - lo + 1) + lo).cast("int")
        return F.date_add(c, days) if isinstance(kind, T.DateType) else (c + F.make_dt_interval(days))
    text = c.cast("string")
    days = (index_of(ctx.digest(text, T.StringType()), hi - lo + 1) + lo).cast("int")
    fmt = o.get("date_format")
    if fmt is None:
        return text
    when = parse(F.trim(text), fmt)
    return F.coalesce(F.date_format(when + F.make_dt_interval(days), java_format(fmt)), text)


def cipher(ctx: Context) -> fpes.Cipher:
    o = ctx.options
    if ctx.namespace is None:
        raise MaskError("deterministic_namespace_missing", ctx.column)
    return fpes.Cipher(ctx.kernel.derive(ctx.namespace, b"fpe"), o.get("tweak", ctx.column), o.get("charset", "digits"), o.get("preserve_separators", True), o.get("validate_luhn", False))


def fpe(c: Column, kind: T.DataType, ctx: Context) -> Column:
    return fpes.fpe_column(c, cipher(ctx))


def pool_of(ctx: Context, provider: str) -> list[str]:
    size = int(ctx.options.get("pool_size") or ctx.pool_size)
    return words.pool(provider, size, ctx.kernel.seed, ctx.options.get("locale", "en_US"), ctx.namespace, options=ctx.options)


def faker(c: Column, kind: T.DataType, ctx: Context) -> Column:
    provider = ctx.provider or ""
    if provider in IDENTIFIERS:
        return keep_null(c, identifier(ctx.digest(c, kind) if ctx.deterministic else ctx.row_draw(), provider, ctx.options))
    if not words.known(provider):
        raise MaskError("unknown_provider", provider)
    if provider in words.NON_POOLABLE or provider in words.COMPOSITES:
        raise MaskError("non_poolable_provider_with_pool_backend", provider)
    values = pool_of(ctx, provider)
    digest = ctx.digest(c, kind) if ctx.deterministic else ctx.row_draw()
    return keep_null(c, pick(index_of(digest, len(values)), values))


def identifier(digest: Column, provider: str, options: dict) -> Column:
    o = options
    if provider == "synthetic_mrn":
        return IDENTIFIERS[provider](digest, int(o.get("mrn_digit_count", 8)), str(o.get("mrn_alpha_prefix", "")), bool(o.get("allow_leading_zero", False)))
    if provider == "synthetic_ndc":
        return IDENTIFIERS[provider](digest, tuple(o.get("ndc_segment_layout", (5, 4, 2))))
    return IDENTIFIERS[provider](digest)


def formula(c: Column, kind: T.DataType, ctx: Context) -> Column:
    text = ctx.options.get("expression") or ctx.options.get("formula")
    if not text:
        raise MaskError("formula_missing", ctx.column)
    draw = lambda i: ctx.kernel.digest(f"formula/{ctx.column}/{i}", F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    return keep_null(c, Translator({"value": c}, draw).translate(text))


def text_redact(c: Column, kind: T.DataType, ctx: Context) -> Column:
    from ..functions.detectors import redact_spans

    if ctx.options.get("ner"):
        raise MaskError("ner_unavailable", "no entity model is installed")
    return redact_spans(c, ctx.options.get("detectors"), ctx.options.get("token", "[REDACTED]"), bool(ctx.options.get("label_token", False)))


def nested(c: Column, kind: T.DataType, ctx: Context) -> Column:
    from .nested import mask_path

    return mask_path(c, kind, ctx)


STRATEGIES: dict[str, Callable[[Column, T.DataType, Context], Column]] = {
    "passthrough": passthrough, "redact": redact, "truncate": truncate, "bucketize": bucketize, "hash": hash_, "categorical": categorical, "date_shift": date_shift,
    "fpe": fpe, "faker": faker, "formula": formula, "text_redact": text_redact, "nested": nested,
}
#: Strategies of a value alone: those that a stream may use.
STATELESS = {"passthrough", "redact", "truncate", "bucketize", "hash", "fpe", "text_redact", "date_shift"}
#: Strategies that keyed digests of nullable integers were once ambiguous for; strict_compat refuses them.
KEYED = {"hash", "categorical", "truncate"}


def strategy(name: str):
    if name not in STRATEGIES:
        raise MaskError("unknown_strategy", name)
    return STRATEGIES[name]


def gate(predicate: Column, masked: Column, original: Column) -> Column:
    """`when`: masked where the predicate holds, the original elsewhere and where it is null."""
    return F.when(F.coalesce(predicate, F.lit(False)), masked).otherwise(original)


def shuffle(df: DataFrame, column: str, ctx: Context, key: str, predicate: Column | None = None) -> DataFrame:
    """The column's non-null values (of the rows where the predicate holds) dealt anew among these rows.

    Rows are numbered twice without ever meeting in one task: cells by hash are counted, the counts are summed
    in a table of `cells` rows, and a row's number is its cell's start plus its rank in the cell. The join on
    numbers gives each row another row's value.
    """
    cells = 1024
    live = F.col(column).isNotNull() & (F.coalesce(predicate, F.lit(False)) if predicate is not None else F.lit(True))
    rows = df.where(live).select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    salt = ctx.kernel.derive(ctx.namespace or f"shuffle/{ctx.column}", b"").hex()[:16]

    def numbered(label: str, keep: str) -> DataFrame:
        h = F.xxhash64(F.lit(salt + label), F.col("_k").cast("string"))
        cell = rows.withColumn("_h", h).withColumn("_cell", F.pmod("_h", F.lit(cells)))
        counts = cell.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
        starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).select("_cell", "_start")  # `cells` rows
        ranked = cell.withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "_k")))
        return ranked.join(F.broadcast(starts), "_cell").select((F.col("_start") + F.col("_r")).alias("_at"), keep)

    dealt = numbered("to", "_k").join(numbered("from", "_v"), "_at").select(F.col("_k").alias(key), F.col("_v").alias("_dealt"))
    out = df.join(dealt, key, "left")
    return out.select(*[F.when(live, F.col("_dealt")).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in df.columns])


def pooled(df: DataFrame, column: str, ctx: Context, mode: str, key: str | None = None, scale: float = 2.0) -> DataFrame:
    """The cardinality modes of a pool that need the column's distinct values.

    unique: rows get different values; match_source_cardinality and scale_source_cardinality: equal values
    stay equal, and there are as many (scale: about that many times) as in the source.
    """
    if mode == "unique":
        if ctx.namespace is not None and ctx.deterministic and ctx.options.get("deterministic"):
            raise MaskError("unique_deterministic_conflict", column)
        n = df.where(F.col(column).isNotNull()).count()
        values = pool_of(ctx, ctx.provider or "") if n <= ctx.pool_size else []
        if n > len(values):
            raise MaskError("uniqueness_impossible", f"{n} rows, {len(values)} values")
        return lookup(df, column, ranks(df.where(F.col(column).isNotNull()).select(F.col(key).alias("_k")), ctx, "_k"), F.col(key), values, n)
    distinct = df.select(F.col(column).alias("_k")).where("_k is not null").distinct()
    n = distinct.count()
    target = n if mode == "match_source_cardinality" else max(1, round(n * scale))
    values = pool_of(ctx, ctx.provider or "")
    if target > len(values):
        raise MaskError("pool_capacity", f"{target} values needed, {len(values)} in the pool")
    return lookup(df, column, ranks(distinct, ctx, "_k"), F.col(column), values, target)


def ranks(keys: DataFrame, ctx: Context, key: str) -> DataFrame:
    """(key, _rank from 0) in order of the keys, by ranges: a count per range, then ranks within."""
    by_range = keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    starts = by_range.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    starts = starts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # a row per partition
    return by_range.join(F.broadcast(starts), "_p").select(key, (F.col("_before") + F.col("_i") - F.col("_lo")).alias("_rank"))


def lookup(df: DataFrame, column: str, ranked: DataFrame, on: Column, values: list, n: int) -> DataFrame:
    chosen = ranked.withColumn("_new", pick(F.pmod("_rank", F.lit(max(1, n))), values)).drop("_rank")
    out = df.join(chosen, on == F.col("_k"), "left")
    return out.select(*[F.col("_new").alias(column) if c == column else df[c] for c in df.columns])


def keyed_number(digest: Column, size: int) -> Column:
    return slice_number(digest, 0, 6) % size
