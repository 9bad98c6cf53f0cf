"""Masks of fields inside structs, arrays and JSON texts, by a path ($.a.b, $.a[*].b, $.a[0], $..b)."""

from __future__ import annotations

import json
import re
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError

STEP = re.compile(r"\.\.(\w+)|\.(\w+)|\['([^']+)'\]|\[(\*|\d+)\]|\.(\*)")


def steps(path: str) -> list[tuple[str, str]]:
    """(kind, name) of each step: key, index, each, deep."""
    if not path.startswith("$"):
        raise MaskError("nested_path_invalid", path)
    out, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise MaskError("nested_path_invalid", path)
        deep, key, quoted, index, star = m.groups()
        out.append(("deep", deep) if deep else ("key", key or quoted) if key or quoted else ("each", "*") if star or index == "*" else ("index", index))
        at = m.end()
    return out


def mask_path(c: Column, kind: T.DataType, ctx) -> Column:
    from .strategies import strategy

    o = ctx.options
    path, child = steps(o["target"]), o["strategy"]
    inner = replace(ctx, options=dict(o.get("strategy_config") or {}))
    apply = lambda x, k: strategy(child)(x, k, inner)
    if isinstance(kind, T.StringType):
        return json_path(c, path, apply, inner, child)
    return typed_path(c, kind, path, apply)


def typed_path(c: Column, kind: T.DataType, path: list[tuple[str, str]], apply) -> Column:
    """Structs and arrays stay in generated code: withField and transform."""
    if not path:
        return apply(c, kind)
    (what, name), rest = path[0], path[1:]
    if what == "key" and isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), c.withField(f"`{name}`", typed_path(c[name], kind[name].dataType, rest, apply)))
    if what == "each" and isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: typed_path(x, kind.elementType, rest, apply))
    if what == "index" and isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x, i: F.when(i == int(name), typed_path(x, kind.elementType, rest, apply)).otherwise(x))
    if what == "each" and isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, x: typed_path(x, kind.valueType, rest, apply))
    raise MaskError("nested_path_type", f"{what} {name} in {kind.simpleString()}")


def places(value, path, at=()):
    if not path:
        yield at
        return
    (what, name), rest = path[0], path[1:]
    if what == "key" and isinstance(value, dict) and name in value:
        yield from places(value[name], rest, (*at, name))
    elif what == "index" and isinstance(value, list) and int(name) < len(value):
        yield from places(value[int(name)], rest, (*at, int(name)))
    elif what == "each":
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            yield from places(v, rest, (*at, k))
    elif what == "deep":
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            if k == name:
                yield from places(v, rest, (*at, k))
            yield from places(v, path, (*at, k))


def load(text):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, TypeError):
        return None


def json_path(c: Column, path, apply, ctx, child: str) -> Column:
    """Irregular JSON: leaves go out as an array of texts, are masked as Columns, and go back in. Texts that don't parse stay."""

    @F.pandas_udf("array<string>")
    def leaves(texts: pd.Series) -> pd.Series:
        def of(text):
            doc = load(text)
            found = []
            for at in places(doc, path) if isinstance(doc, dict | list) else ():
                v = doc
                for k in at:
                    v = v[k]
                found.append(None if v is None else v if isinstance(v, str) else json.dumps(v))
            return found

        return texts.map(of)

    @F.pandas_udf("string")
    def put(texts: pd.Series, masked: pd.Series) -> pd.Series:
        def of(text, new):
            doc = load(text)
            if not isinstance(doc, dict | list):
                return text
            for at, v in zip(list(places(doc, path)), new if new is not None else [], strict=True):
                x = doc
                for k in at[:-1]:
                    x = x[k]
                x[at[-1]] = v
            return json.dumps(doc, ensure_ascii=False)

        return pd.Series([of(t, m) for t, m in zip(texts, masked, strict=True)], dtype=object)

    return put(c, F.transform(leaves(c), lambda x: apply(x, T.StringType())))
