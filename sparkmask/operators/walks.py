"""Schema walks: inferred foreign keys, hazards of the table graph, and drift between two schemas. Driver-side: tens of tables."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

HUB = 5


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    nullable: bool = True
    pk: bool = False


@dataclass(frozen=True)
class Link:
    source_table: str
    source_column: str
    target_table: str
    target_column: str
    declared: bool = True


@dataclass(frozen=True)
class Hazard:
    kind: str
    table: str
    description: str


Schema = dict[str, tuple[Column, ...]]


def schema_of(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> Schema:
    return {t: tuple(Column(f.name, f.dataType.simpleString(), f.nullable, f.name in (keys or {}).get(t, [])) for f in df.schema.fields) for t, df in tables.items()}


def infer_links(schema: Schema, declared: list[Link] = ()) -> list[Link]:
    """<stem>_id -> the table <stem>, <stem>s or <stem>es that has a key `id`; declared columns are left alone."""
    taken = {(e.source_table, e.source_column) for e in declared}
    out = []
    for t, columns in schema.items():
        for c in columns:
            if not c.name.endswith("_id") or (t, c.name) in taken:
                continue
            stem = c.name[:-3]
            target = next((x for x in (stem, f"{stem}s", f"{stem}es", f"{stem[:-1]}ies") if x in schema), None)
            if target and any(k.name == "id" and k.pk for k in schema[target]):
                out.append(Link(t, c.name, target, "id", False))
    return sorted(out, key=lambda e: (e.source_table, e.source_column, e.target_table))


def cross_file(schemas: dict[str, Schema]) -> list[Link]:
    """Links between files: a column named like the only key of another file's table, of the same type."""
    keys = {(f, t): [c for c in cols if c.pk] for f, s in schemas.items() for t, cols in s.items()}
    out = []
    for f, s in schemas.items():
        for t, cols in s.items():
            for c in cols:
                for (g, u), pk in keys.items():
                    if g != f and len(pk) == 1 and pk[0].name == c.name and pk[0].type == c.type and not c.pk:
                        out.append(Link(f"{f}.{t}", c.name, f"{g}.{u}", c.name, False))
    return sorted(out, key=lambda e: (e.source_table, e.source_column, e.target_table))


def cycles(links: list[Link]) -> list[tuple[str, ...]]:
    """Cycles of two tables and more, each once, rotated to begin with its least table."""
    after: dict[str, set[str]] = defaultdict(set)
    for e in links:
        if e.source_table != e.target_table:
            after[e.source_table].add(e.target_table)
    found: set[tuple[str, ...]] = set()
    for start in sorted(after):
        stack = [(start, (start,))]
        while stack:
            t, path = stack.pop()
            for u in sorted(after.get(t, ())):
                if u == start:
                    found.add(path)
                elif u > start and u not in path:  # a cycle is found from its least table
                    stack.append((u, (*path, u)))
    return sorted(found)


def hazards(schema: Schema, links: list[Link] = ()) -> list[Hazard]:
    links = [*links, *infer_links(schema, list(links))]
    out, into, pairs, nullable = [], defaultdict(int), defaultdict(set), defaultdict(dict)
    for e in links:
        into[e.target_table] += 1
        if e.source_table == e.target_table:
            out.append(Hazard("SR", e.source_table, f"{e.source_table}.{e.source_column} references its own table"))
        else:
            pairs[e.source_table, e.target_table].add(e.source_column)
        if e.declared and any(c.name == e.source_column and c.nullable for c in schema.get(e.source_table, ())):
            nullable[e.source_table][e.target_table] = e.source_column
    out += [Hazard("HUB", t, f"{t} is referenced by {n} columns") for t, n in into.items() if n >= HUB]
    out += [Hazard("PE", a, f"{a} references {b} by {', '.join(sorted(c))}") for (a, b), c in pairs.items() if len(c) > 1]
    out += [Hazard("ALT", t, f"{t} has nullable references to {', '.join(sorted(x))}") for t, x in nullable.items() if len(x) > 1]
    fixed = {(e.source_table, e.source_column) for e in links if e.declared}
    for t, columns in schema.items():
        names = {c.name.lower() for c in columns}
        out += [Hazard("PM", t, f"{t}.{c[:-5]}_id depends on {t}.{c}") for c in names if c.endswith("_type") and f"{c[:-5]}_id" in names and (t, f"{c[:-5]}_id") not in fixed]
    out += [Hazard("CIR", c[0], " -> ".join([*c, c[0]])) for c in cycles(links)]
    return sorted(dict.fromkeys(out), key=lambda h: (h.kind, h.table, h.description))


def drift(before: Schema, after: Schema) -> list[tuple[str, str, str]]:
    """(table, column, change): added, removed, type, null or pk."""
    out = [(t, "", "added") for t in after.keys() - before.keys()] + [(t, "", "removed") for t in before.keys() - after.keys()]
    for t in before.keys() & after.keys():
        a, b = ({c.name: c for c in s[t]} for s in (before, after))
        out += [(t, c, "added") for c in b.keys() - a.keys()] + [(t, c, "removed") for c in a.keys() - b.keys()]
        for c in a.keys() & b.keys():
            out += [(t, c, what) for what, x, y in (("type", a[c].type, b[c].type), ("null", a[c].nullable, b[c].nullable), ("pk", a[c].pk, b[c].pk)) if x != y]
    return sorted(out)
