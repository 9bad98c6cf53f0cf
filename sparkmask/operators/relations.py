"""Foreign keys: the graph of tables, and consistent masking of children by left joins with their parents' keys."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MaskError

POLICIES = ("preserve", "remap", "warn", "fail")


@dataclass(frozen=True)
class Edge:
    parent_table: str
    parent_columns: tuple[str, ...]
    child_table: str
    child_columns: tuple[str, ...]
    namespace: str
    orphan_policy: str

    def check(self) -> Edge:
        if not self.orphan_policy:
            raise MaskError("orphan_fk_policy_missing", self.child_table)
        if self.orphan_policy not in POLICIES:
            raise MaskError("orphan_fk_policy_invalid", self.orphan_policy)
        if len(self.parent_columns) != len(self.child_columns):
            raise MaskError("composite_columns_length_mismatch", self.child_table)
        return self


class Graph:
    """Tables in an order in which parents come first; equal edges count once."""

    def __init__(self, edges: list[Edge], tables: list[str] = ()):
        self.edges = list(dict.fromkeys(e.check() for e in edges))
        policies: dict[tuple, str] = {}
        for e in self.edges:
            k = (e.child_table, e.child_columns, e.parent_table, e.parent_columns)
            if policies.setdefault(k, e.orphan_policy) != e.orphan_policy:
                raise MaskError("orphan_policy_conflict", e.child_table)
        self.order = self.sort(sorted({*tables, *(t for e in self.edges for t in (e.parent_table, e.child_table))}))

    def sort(self, tables: list[str]) -> list[str]:
        below = {t: {e.parent_table for e in self.edges if e.child_table == t and e.parent_table != t} for t in tables}
        ready = [t for t in tables if not below[t]]
        heapq.heapify(ready)
        out = []
        while ready:
            t = heapq.heappop(ready)
            out.append(t)
            for u in tables:
                if t in below[u]:
                    below[u].remove(t)
                    if not below[u]:
                        heapq.heappush(ready, u)
        if len(out) < len(tables):
            raise MaskError("fk_cycle", ", ".join(sorted(set(tables) - set(out))))
        return out

    def of_child(self, table: str) -> dict[tuple[str, ...], list[Edge]]:
        out: dict[tuple[str, ...], list[Edge]] = {}
        for e in self.edges:
            if e.child_table == table:
                out.setdefault(e.child_columns, []).append(e)
        return out


def key_map(source: DataFrame, masked_columns: dict[str, Column], columns: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """Distinct (k0.., m0..) of a parent: its keys and what they become. Of a repeated key with an order, the last row's."""
    rows = source.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], *[masked_columns.get(c, F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)], *([order.alias("_o")] if order is not None else []))
    keys, masks = [f"k{i}" for i in range(len(columns))], [f"m{i}" for i in range(len(columns))]
    rows = rows.dropna(subset=keys)
    if order is None:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*masks), "_o").alias("m")).select(*keys, "m.*")


def resolve(child: DataFrame, columns: tuple[str, ...], maps: list[DataFrame], policy: str, remapped: list[Column] | None = None) -> DataFrame:
    """child with its key columns replaced by what the parents' maps say; the first map that has the key wins.

    A key with a null part stays as it is and is never an orphan. Orphans: preserve and warn keep the key, remap takes
    `remapped` (the parent's strategy on the child's own key), fail keeps it too (callers count with `orphans`).
    """
    if policy not in POLICIES:
        raise MaskError("orphan_fk_policy_invalid", policy)
    out, hits = child, []
    for j, m in enumerate(maps):
        names = {f"k{i}": f"_k{j}_{i}" for i in range(len(columns))} | {f"m{i}": f"_m{j}_{i}" for i in range(len(columns))}
        m = m.select(*[F.col(a).alias(b) for a, b in names.items()], F.lit(True).alias(f"_hit{j}"))
        on = reduce(lambda a, b: a & b, [F.col(c).cast(m.schema[f"_k{j}_{i}"].dataType) == F.col(f"_k{j}_{i}") for i, c in enumerate(columns)])
        out = out.join(m, on, "left")
        hits.append(F.col(f"_hit{j}"))
    found = F.coalesce(*hits, F.lit(False))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    new = {}
    for i, c in enumerate(columns):
        value = None
        for j in range(len(maps)):
            value = F.when(hits[j], F.col(f"_m{j}_{i}")) if value is None else value.when(hits[j], F.col(f"_m{j}_{i}"))
        other = remapped[i] if policy == "remap" and remapped is not None else F.col(c)
        new[c] = F.when(found, value.cast("string")).when(whole & ~found, other.cast("string")).otherwise(F.col(c).cast("string"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in child.columns])


def orphans(child: DataFrame, columns: tuple[str, ...], parents: list[tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Rows of child whose whole key no parent has."""
    out = child.dropna(subset=list(columns))
    for parent, names in parents:
        keys = parent.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(names)]).distinct()
        out = out.join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]), "left_anti")
    return out
