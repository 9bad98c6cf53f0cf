"""From a configuration to a frozen plan: namespaces, table order, and the checks that need no data."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import yaml
from pydantic import ValidationError
from pyspark.sql import types as T

from ..errors import MaskError
from ..functions import words
from ..functions.kernel import SALT, Kernel, seed_bytes
from ..operators import composite
from ..operators.relations import Edge, Graph
from ..operators.strategies import KEYED, STATELESS, STRATEGIES
from .config import MaskColumn, PipelineConfig

NEEDS_NAMESPACE = {"hash", "fpe", "date_shift"}


@dataclass(frozen=True)
class Plan:
    config: PipelineConfig
    seed: bytes
    salt: bytes
    order: tuple[str, ...]
    edges: tuple[Edge, ...]
    namespaces: dict[tuple[str, str], str]
    config_hash: str
    warnings: tuple[str, ...] = field(default=())

    @property
    def kernel(self) -> Kernel:
        return Kernel(int.from_bytes(self.seed, "big"), self.salt)

    @property
    def graph(self) -> Graph:
        return Graph(list(self.edges), list(self.config.tables))

    def to_yaml(self) -> str:
        return yaml.safe_dump({"seed": int.from_bytes(self.seed, "big"), "salt": self.salt.decode(), "order": list(self.order), "config_hash": self.config_hash, "config": self.config.model_dump(exclude_none=True)}, sort_keys=True)

    @staticmethod
    def from_yaml(text: str) -> Plan:
        return compile_plan(yaml.safe_load(text)["config"])


def namespaces_of(config: PipelineConfig, edges: list[Edge]) -> dict[tuple[str, str], str]:
    """The namespace of each masked column: its own, that of `namespaces`, or its relationship's; two different ones are an error."""
    found: dict[tuple[str, str], set[str]] = {}
    for t, spec in config.tables.items():
        for c in spec.columns:
            if c.namespace:
                found.setdefault((t, c.name), set()).add(c.namespace)
    for ns, members in config.namespaces.items():
        for m in members:
            t, _, c = m.partition(".")
            found.setdefault((t, c), set()).add(ns)
    for e in edges:
        for t, columns in ((e.parent_table, e.parent_columns), (e.child_table, e.child_columns)):
            for c in columns:
                if e.namespace and not found.get((t, c)):
                    found.setdefault((t, c), set()).add(e.namespace)
    if bad := [f"{t}.{c}" for (t, c), n in found.items() if len(n) > 1]:
        raise MaskError("namespace_ambiguity", ", ".join(sorted(bad)))
    return {k: next(iter(v)) for k, v in found.items()}


def check_column(t: str, c: MaskColumn, namespace: str | None, child: bool) -> None:
    where = f"{t}.{c.name}"
    if c.strategy not in STRATEGIES and c.strategy not in ("shuffle", "composite"):
        raise MaskError("unknown_strategy", f"{where}: {c.strategy}")
    if c.provider and not words.known(c.provider):
        raise MaskError("unknown_provider", f"{where}: {c.provider}")
    if c.strategy == "faker":
        if not c.provider:
            raise MaskError("unknown_provider", where)
        if c.provider in words.NON_POOLABLE:
            raise MaskError("non_poolable_provider_with_pool_backend", f"{where}: {c.provider}")
    if c.strategy == "composite":
        composite.check_wiring([c.name, *c.coherent_with], c.provider or "", namespace, c.provider_config)
    if c.when and c.coherent_with:
        raise MaskError("when_with_coherent_with_unsupported", where)
    if c.strategy in NEEDS_NAMESPACE and namespace is None and not child:
        raise MaskError("deterministic_namespace_missing", where)
    if c.strategy == "categorical" and c.deterministic and namespace is None:
        raise MaskError("categorical_requires_namespace", where)
    if c.strategy == "faker" and c.deterministic and c.cardinality_mode == "reuse" and namespace is None:
        raise MaskError("deterministic_namespace_missing", where)
    if c.allow_collisions and c.cardinality_mode != "reuse":
        raise MaskError("allow_collisions_mode_conflict", where)
    if c.strategy == "text_redact" and c.provider_config.get("ner"):
        raise MaskError("ner_unavailable", where)
    if c.vault and (namespace is None or c.strategy in ("shuffle", "passthrough")):
        raise MaskError("vault_unsupported", where)


def compile_plan(config: dict | PipelineConfig) -> Plan:
    try:
        c = config if isinstance(config, PipelineConfig) else PipelineConfig.model_validate(config)
    except ValidationError as e:
        raise MaskError("config_invalid", "; ".join(f"{'.'.join(map(str, x['loc']))}: {x['msg']}" for x in e.errors())) from None
    edges = []
    for r in c.relationships:
        if r.orphan_policy is None:
            raise MaskError("orphan_fk_policy_missing", r.child_table)
        edges.append(Edge(r.parent_table, tuple(r.parent_columns), r.child_table, tuple(r.child_columns), r.namespace or "", r.orphan_policy))
    graph = Graph(edges, list(c.tables))
    names = namespaces_of(c, edges)
    children = {(e.child_table, x) for e in edges for x in e.child_columns}
    for t, spec in c.tables.items():
        for col in spec.columns:
            check_column(t, col, names.get((t, col.name)), (t, col.name) in children)
    for e in edges:
        for t in (e.parent_table, e.child_table):
            if t not in c.tables:
                raise MaskError("relationship_table_unknown", t)
        for k in e.parent_columns:
            if not any(col.name == k for col in c.tables[e.parent_table].columns) and (e.parent_table, k) not in children and c.tables[e.parent_table].columns:
                continue  # an unmasked parent key stays as it is, and so do its children's
    body = c.model_dump(exclude={"sources", "targets"})
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
    salt = c.global_settings.derivation_salt.encode() if c.global_settings.derivation_salt else SALT
    return Plan(c, seed_bytes(c.global_settings.seed), salt, tuple(graph.order), tuple(graph.edges), names, digest)


def check_schema(plan: Plan, table: str, schema: T.StructType) -> None:
    """Checks that need the table's types."""
    keyed_children = {(e.child_table, x) for e in plan.edges for x in e.child_columns}
    for c in plan.config.tables[table].columns:
        if c.name not in schema.fieldNames():
            raise MaskError("column_missing", f"{table}.{c.name}")
        f = schema[c.name]
        if plan.config.global_settings.strict_compat and c.strategy in KEYED and f.nullable and isinstance(f.dataType, T.IntegralType) and (table, c.name) not in keyed_children:
            raise MaskError("null_bearing_int_unsupported", f"{table}.{c.name}")


def streamable(plan: Plan, table: str) -> bool:
    """Whether a table's masks need nothing but a row's own values."""
    spec = plan.config.tables[table]
    if spec.generate_columns or any(e.child_table == table for e in plan.edges):
        return False
    for c in spec.columns:
        keyed = c.strategy in ("faker", "categorical") and c.deterministic and c.cardinality_mode == "reuse" and (table, c.name) in plan.namespaces
        if c.strategy not in STATELESS and not keyed:
            return False
        if c.strategy == "date_shift" and "date_format" not in c.provider_config:
            return False
    return True


def validate(config: dict) -> list[str]:
    """The code of what is wrong with a config, or nothing."""
    try:
        compile_plan(config)
    except MaskError as e:
        return [f"{e.code}: {e}"]
    return []
