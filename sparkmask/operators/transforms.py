"""Row transforms of a table, in order: filter, sort, limit, dedupe, derive, drop_column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError
from ..functions.expressions import column_expression


def predicate(df: DataFrame, text: str, code: str = "filter") -> Column:
    try:
        out = column_expression(text, df.columns)
        kind = df.select(out.alias("x")).schema["x"].dataType
    except MaskError:
        raise
    except Exception as e:  # the analyser's own errors
        raise MaskError(f"{code}_expression_error", str(e).split("\n")[0]) from None
    if not isinstance(kind, T.BooleanType):
        raise MaskError(f"{code}_expression_not_boolean", kind.simpleString())
    return out


def missing(df: DataFrame, columns: list[str], code: str) -> None:
    if absent := [c for c in columns if c not in df.columns]:
        raise MaskError(code, ", ".join(absent))


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    return df.where(predicate(df, expression))


def sort_rows(df: DataFrame, by: str | list[str], ascending: bool | list[bool] = True, row_key: str | None = None) -> DataFrame:
    """Nulls last in both directions; ties in order of row_key, if there is one."""
    by = [by] if isinstance(by, str) else list(by)
    missing(df, by, "sort_column_missing")
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(up) != len(by):
        raise MaskError("sort_length_mismatch")
    keys = [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in zip(by, up, strict=True)]
    return df.orderBy(*keys, *([F.col(row_key)] if row_key else []))


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise MaskError("limit_invalid", repr(n))
    return df.limit(n)


def dedupe(df: DataFrame, columns: list[str] | None = None, row_key: str | None = None) -> DataFrame:
    """One row of each group of equal values (nulls are equal): the first by row_key. Groups are combined before the shuffle."""
    if columns is None:
        return df.distinct()
    missing(df, columns, "dedupe_column_missing")
    if row_key is None:
        return df.dropDuplicates(columns)
    rest = [c for c in df.columns if c not in columns]
    if not rest:
        return df.distinct()
    if all(isinstance(df.schema[c].dataType, T.NumericType | T.DateType | T.TimestampType | T.BooleanType) for c in rest):
        w = Window.partitionBy(*columns).orderBy(row_key)
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    first = df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.col(row_key)).alias("_r"))
    return first.select(*[F.col(c) if c in columns else F.col(f"_r.{c}").alias(c) for c in df.columns])


def derive(df: DataFrame, column: str, expression: str) -> DataFrame:
    if column in df.columns:
        raise MaskError("derive_column_exists", column)
    try:
        return df.withColumn(column, column_expression(expression, df.columns))
    except MaskError:
        raise
    except Exception as e:
        raise MaskError("derive_expression_error", str(e).split("\n")[0]) from None


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing(df, columns, "drop_column_missing")
    return df.drop(*columns)


def apply_transforms(df: DataFrame, transforms: list[dict], row_key: str | None = None) -> DataFrame:
    """Each transform sees what the one before returned. {op: filter, expression: ...} and so on."""
    for t in transforms:
        o = dict(t)
        op = o.pop("op", None) or o.pop("type", None)
        if op == "filter":
            df = filter_rows(df, o["expression"])
        elif op == "sort":
            df = sort_rows(df, o["by"], o.get("ascending", True), row_key)
        elif op == "limit":
            df = limit_rows(df, o["n"])
        elif op == "dedupe":
            df = dedupe(df, o.get("columns"), row_key)
        elif op == "derive":
            df = derive(df, o["column"], o["expression"])
        elif op == "drop_column":
            df = drop_columns(df, [o["columns"]] if isinstance(o["columns"], str) else o["columns"])
        else:
            raise MaskError("transform_unknown", repr(op))
    return df
