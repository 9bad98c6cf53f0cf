"""Runs a plan: generated tables first, then masks in the order of the table graph. Results are lazy DataFrames.

A masked table is one select of expressions over its source; a composite's digest is made in an inner
projection; a foreign key is one left join per parent. Actions run only where a result needs a number of
the data: date formats without a setting (200 rows), pool modes (distinct counts), texts that may need
Unicode normalising (one aggregate), and orphan counts under `fail` and `warn`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import MaskError
from ..functions.kernel import canonical_column, needs_nfc
from ..operators import audit, composite, generate, relations, strategies, transforms, vault
from ..operators.profile import run_profile
from ..sources.files import read_source, write_target
from .compile import Plan, check_schema, compile_plan
from .config import MaskColumn


@dataclass
class Result:
    tables: dict[str, DataFrame]
    plan: Plan
    warnings: list[str] = field(default_factory=list)
    profiles: dict[str, dict] = field(default_factory=dict)
    quality: dict | None = None
    vault: DataFrame | None = None


def context(plan: Plan, table: str, c: MaskColumn, df: DataFrame, nfc: bool = False) -> strategies.Context:
    key = plan.config.tables[table].row_key
    row = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in key]) if key else None
    options = dict(c.provider_config)
    size = c.pool_size or options.get("pool_size") or 10_000
    return strategies.Context(plan.kernel, c.name, plan.namespaces.get((table, c.name)), options, c.deterministic or c.allow_collisions, c.provider, nfc, int(size), row, tuple(df.columns))


KEYED_TEXTS = ("hash", "categorical", "faker", "composite")


def rewritten(plan: Plan, table: str, df: DataFrame, columns: tuple[str, ...] | None = None) -> set[str]:
    """The columns (of `columns`) whose digests need their texts normalised first."""
    return set(needs_nfc(df, [c.name for c in plan.config.tables[table].columns if c.strategy in KEYED_TEXTS and (columns is None or c.name in columns)]))


def value_mask(plan: Plan, table: str, c: MaskColumn, df: DataFrame, nfc: bool, inner: dict[str, Column] | None = None, column: Column | None = None) -> Column:
    """What a column's value becomes by its own row alone: tables, keys of foreign keys and streams have the same expression.

    `column` stands for the table's own column; another one (a child's key) is masked whatever `when` says, as its row has
    no columns of the parent.
    """
    ctx = context(plan, table, c, df, nfc)
    kind = df.schema[c.name].dataType
    if inner is not None and c.strategy in ("categorical", "faker", "date_shift"):
        ctx.inner = inner
    if c.strategy == "date_shift" and "date_format" not in ctx.options:
        if df.isStreaming:
            raise MaskError("stream_unsupported", f"{table}.{c.name}: date_shift on a stream needs a date_format")
        ctx.options["date_format"] = strategies.detect_format(df, c.name)
    own = F.col(f"`{c.name}`")
    masked = strategies.strategy(c.strategy)(own if column is None else column, kind, ctx)
    if not c.when or column is not None:
        return masked
    made = df.select("*", *[v.alias(k) for k, v in (inner or {}).items()])
    return strategies.gate(transforms.predicate(df, c.when, "when"), masked, own.cast(masked_type(made, masked)))


def mask_columns(plan: Plan, table: str, df: DataFrame) -> DataFrame:
    """The table with all columns masked that aren't foreign keys of it."""
    spec = plan.config.tables[table]
    children = {x for e in plan.edges if e.child_table == table for x in e.child_columns}
    mine = [c for c in spec.columns if c.name not in children]
    rewrite = rewritten(plan, table, df, tuple(c.name for c in mine))
    plain: dict[str, Column] = {}
    inner: dict[str, Column] = {}
    for c in mine:
        if c.strategy in ("shuffle",) or (c.strategy == "faker" and c.cardinality_mode != "reuse"):
            continue
        if c.strategy == "composite":
            ctx = context(plan, table, c, df, c.name in rewrite)
            ctx.inner = inner
            made = composite.bundle(ctx.digest(F.col(c.name), df.schema[c.name].dataType), c.provider, c.provider_config)
            plain.update({out: F.when(F.col(c.name).isNotNull(), made[k]) for out, k in zip([c.name, *c.coherent_with], made, strict=True)})
            continue
        plain[c.name] = value_mask(plan, table, c, df, c.name in rewrite, inner)
    out = df.select("*", *[v.alias(k) for k, v in inner.items()]) if inner else df
    out = out.select(*[plain[x].alias(x) if x in plain else F.col(f"`{x}`") for x in df.columns])
    for c in mine:
        ctx = context(plan, table, c, df)
        if c.strategy == "shuffle":
            if len(spec.row_key) != 1:
                raise MaskError("row_key_missing", f"{table}: shuffle needs a row_key of one column")
            gate = transforms.predicate(df, c.when, "when") if c.when else None
            out = strategies.shuffle(out, c.name, ctx, spec.row_key[0], gate)
        elif c.strategy == "faker" and c.cardinality_mode != "reuse":
            if c.cardinality_mode == "unique" and len(spec.row_key) != 1:
                raise MaskError("row_key_missing", f"{table}: unique needs a row_key of one column")
            out = strategies.pooled(out, c.name, ctx, c.cardinality_mode, spec.row_key[0] if spec.row_key else None, c.scale)
    return out


def masked_type(df: DataFrame, masked: Column) -> T.DataType:
    return df.select(masked.alias("x")).schema["x"].dataType


def key_columns(plan: Plan, table: str, df: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """What a parent's key columns become, as expressions over its source: the same as in the parent's own table."""
    out = {}
    rewrite = rewritten(plan, table, df, columns)
    for c in plan.config.tables[table].columns:
        if c.name in columns:
            if c.strategy in ("shuffle", "composite") or c.cardinality_mode != "reuse":
                raise MaskError("fk_parent_strategy_unsupported", f"{table}.{c.name}: {c.strategy}")
            out[c.name] = value_mask(plan, table, c, df, c.name in rewrite)
    return out


def resolve_keys(plan: Plan, table: str, masked: DataFrame, sources: dict[str, DataFrame], warnings: list[str]) -> DataFrame:
    """The masked table with its foreign keys replaced; parents' keys come from their sources, so a table may be its own parent."""
    out = masked
    for columns, edges in plan.graph.of_child(table).items():
        maps, remapped = [], None
        for e in edges:
            parent = sources[e.parent_table]
            made = key_columns(plan, e.parent_table, parent, e.parent_columns)
            maps.append(relations.key_map(parent, made, e.parent_columns))
            if e.orphan_policy == "remap" and remapped is None:
                unsafe = set(needs_nfc(sources[table], list(columns)))
                remapped = []
                for pc, cc in zip(e.parent_columns, columns, strict=True):
                    spec = next((c for c in plan.config.tables[e.parent_table].columns if c.name == pc), None)
                    own = F.col(cc).cast(parent.schema[pc].dataType)
                    remapped.append(value_mask(plan, e.parent_table, spec, parent, cc in unsafe, column=own) if spec else F.col(cc))
        policy = edges[0].orphan_policy
        if policy in ("fail", "warn"):
            n = relations.orphans(sources[table], columns, [(sources[e.parent_table], e.parent_columns) for e in edges]).count()
            if n and policy == "fail":
                raise MaskError("orphan_fk", f"{n} rows of {table} have no parent")
            if n:
                warnings.append(f"{table}: {n} rows have no parent by {', '.join(columns)}")
        out = relations.resolve(out, columns, maps, policy, remapped)
    return out


def run_pipeline(spark: SparkSession, config: dict, sources: dict[str, DataFrame] | None = None, write: bool = False) -> Result:
    """The masked and generated tables of a configuration. Sources are given, or read as the configuration says."""
    plan = compile_plan(config)
    c = plan.config
    result = Result({}, plan)
    raw = dict(sources or {})
    for t, s in c.sources.items():
        if t not in raw:
            raw[t] = read_source(spark, s.model_dump())
    made = {t: {"rows": s.rows, "columns": {x.name: x.model_dump() for x in s.generate_columns}} for t, s in c.tables.items() if s.generate_columns}
    raw |= generate.generate_tables(spark, made, plan.kernel, {t: d for t, d in raw.items()})
    ready = {}
    for t, spec in c.tables.items():
        if t not in raw:
            raise MaskError("source_missing", t)
        key = spec.row_key[0] if len(spec.row_key) == 1 else None
        ready[t] = transforms.apply_transforms(raw[t], spec.transforms, key)
        check_schema(plan, t, ready[t].schema)
        if c.run_storm:
            result.profiles[t] = run_profile(ready[t], t)
    for t in plan.order:
        if t in made and not any(e.child_table == t for e in plan.edges):
            result.tables[t] = ready[t]
            continue
        result.tables[t] = resolve_keys(plan, t, mask_columns(plan, t, ready[t]), ready, result.warnings)
    pairs = [vault.entries(ready[t], result.tables[t], spec.row_key, col.name, plan.namespaces[t, col.name]) for t, spec in c.tables.items() for col in spec.columns if col.vault]
    for p in pairs:
        result.vault = p if result.vault is None else result.vault.unionByName(p)
    if result.vault is not None:
        result.vault = vault.unambiguous(result.vault)
    if c.global_settings.post_validation:
        o = c.global_settings.post_validation if isinstance(c.global_settings.post_validation, dict) else {}
        result.quality = audit.run_scans(ready, result.tables, {"tables": {t: s.model_dump() for t, s in c.tables.items()}, "relationships": list(plan.edges), "row_keys": {t: s.row_key for t, s in c.tables.items() if s.row_key}, "primary_keys": o.get("primary_keys", {})}, o.get("skip", []))
    if write:
        for t, target in c.targets.items():
            write_target(result.tables[t], target.model_dump())
    return result


def digest_of(plan: Plan, namespace: str, column: Column, kind: T.DataType) -> Column:
    return plan.kernel.digest(namespace, canonical_column(column, kind))
