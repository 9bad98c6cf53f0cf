"""Checks after masking: nine scans with a verdict each, residual personal data, and foreign keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MaskError
from ..functions import detectors as det
from ..functions.identifiers import VALIDATORS
from ..functions.words import LOCALITIES
from . import relations


@dataclass
class Check:
    scan: str
    table: str
    status: str = "pass"
    details: dict = field(default_factory=dict)


def pk_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: non-null keys beyond the first of each value."""
    keys = df.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def cardinality(source: DataFrame, output: DataFrame, column: str) -> DataFrame:
    a = source.agg(F.count_distinct(column).alias("n_source"))
    return a.crossJoin(output.agg(F.count_distinct(column).alias("n_output"), F.count(column).alias("n_rows")))  # one row by one row


def null_audit(source: DataFrame, output: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(column, n_moved): rows whose value is null on one side only, joined by key."""
    a = source.select(*key, *[F.col(c).isNull().alias(f"_a_{c}") for c in columns])
    b = output.select(*key, *[F.col(c).isNull().alias(f"_b_{c}") for c in columns])
    row = a.join(b, key).agg(*[F.count_if(F.col(f"_a_{c}") != F.col(f"_b_{c}")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_moved")) for c in columns])).alias("r")).select("r.*")


def leakage(source: DataFrame, output: DataFrame, column: str) -> DataFrame:
    """One row: output rows whose value is some source value. Both sides are made distinct before they meet."""
    seen = source.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    out = output.select(F.col(column).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return out.join(seen, "v", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_leaked"))


def fixed_points(source: DataFrame, output: DataFrame, key: list[str], column: str) -> DataFrame:
    a, b = source.select(*key, F.col(column).cast("string").alias("_a")), output.select(*key, F.col(column).cast("string").alias("_b"))
    return a.join(b, key).agg(F.count_if(F.col("_a") == F.col("_b")).alias("n_fixed"), F.count("_a").alias("n_rows"))


def determinism(source: DataFrame, output: DataFrame, key: list[str], column: str) -> DataFrame:
    """One row: source values that became more than one output value; over all rows."""
    a, b = source.select(*key, F.col(column).alias("_a")), output.select(*key, F.col(column).alias("_b"))
    per = a.join(b, key).where("_a is not null").groupBy("_a").agg((F.min("_b") != F.max("_b")).alias("split"))
    return per.agg(F.count_if("split").alias("n_split"))


def format_violations(output: DataFrame, column: str, provider: str) -> DataFrame:
    return output.where(F.col(column).isNotNull()).agg(F.count_if(~F.coalesce(VALIDATORS[provider](F.col(column).cast("string")), F.lit(False))).alias("n_bad"))


def coherence(output: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """One row: rows whose bundle doesn't fit together (email of the name, place in the table of places, npi valid)."""
    c = {k: F.col(v) for k, v in columns.items()}
    if kind in ("composite_name_email", "composite_person"):
        name = F.concat_ws(".", c["first_name"], c["last_name"]) if "first_name" in c else F.replace(c["name"], F.lit(" "), F.lit("."))
        bad = F.substring_index(c["email"], "@", 1) != F.lower(name)
    elif kind in ("composite_city_state_zip", "composite_address"):
        bad = ~F.concat_ws("|", c["city"], c["state"], c["zip"]).isin(*["|".join(x) for x in LOCALITIES])
    else:
        bad = ~VALIDATORS["synthetic_npi"](c["npi"])
    return output.agg(F.count_if(bad).alias("n_bad"))


def residual(source: DataFrame, output: DataFrame, key: list[str], columns: list[str], detectors: list[str] | None = None) -> DataFrame:
    """(column, detector, n_match, n_same): values of the output that still match a detector, and those unchanged."""
    pairs = source.select(*key, *[F.col(c).cast("string").alias(f"_a_{c}") for c in columns]).join(output.select(*key, *[F.col(c).cast("string").alias(f"_b_{c}") for c in columns]), key)
    names = [(c, d) for c in columns for d in detectors or ["email", "ssn", "us_phone", "pan", "iban", "ipv4"]]
    row = pairs.agg(*[f for i, (c, d) in enumerate(names) for f in (F.count_if(det.matches(F.col(f"_b_{c}"), d)).alias(f"m{i}"), F.count_if(det.matches(F.col(f"_b_{c}"), d) & (F.col(f"_a_{c}") == F.col(f"_b_{c}"))).alias(f"s{i}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(d).alias("detector"), F.col(f"m{i}").alias("n_match"), F.col(f"s{i}").alias("n_same")) for i, (c, d) in enumerate(names)])).alias("r")).select("r.*")


def fk_severity(n_orphans: int, n_rows: int, policy: str) -> str:
    """Share of orphans: above 1 % critical, above 0.1 % warning; a policy that keeps orphans makes it a note."""
    share = n_orphans / max(1, n_rows)
    if policy in ("preserve", "remap"):
        return "note" if n_orphans else "pass"
    return "critical" if share > 0.01 else "warning" if share > 0.001 else "pass"


def run_scans(source: dict[str, DataFrame], output: dict[str, DataFrame], config: dict, skip: list[str] = ()) -> dict:
    """All scans over the masked tables of a config; a scan that breaks is an error of its own and stops no other.

    config: the tables' columns as in plans.config, plus primary_keys {table: [columns]} and row_keys {table: [columns]}.
    """
    checks: list[Check] = []

    def attempt(scan: str, table: str, run: Callable[[], tuple[str, dict]]) -> None:
        if scan in skip:
            return
        try:
            checks.append(Check(scan, table, *run()))
        except Exception as e:
            checks.append(Check(scan, table, "error", {"message": str(e).split("\n")[0][:300]}))

    row_keys = config.get("row_keys", {})
    for t, spec in config.get("tables", {}).items():
        if t not in output:
            continue
        o, s = output[t], source.get(t)
        if pk := config.get("primary_keys", {}).get(t):
            attempt("pk_uniqueness", t, lambda o=o, pk=pk: (lambda n: ("fail" if n else "pass", {"n_duplicates": n}))(pk_duplicates(o, pk).first()[0]))
        key = row_keys.get(t)
        for c in spec.get("columns", []):
            name, strategy = c["name"], c.get("strategy")
            if s is None or name not in o.columns or strategy in (None, "passthrough"):
                continue
            mode = c.get("cardinality_mode")
            if mode in ("unique", "match_source_cardinality"):
                def card(o=o, s=s, name=name, mode=mode):
                    r = cardinality(s, o, name).first()
                    bad = r["n_output"] != r["n_rows"] if mode == "unique" else r["n_output"] != r["n_source"]
                    return ("fail" if bad and mode == "unique" else "warn" if bad else "pass"), r.asDict()

                attempt("cardinality", f"{t}.{name}", card)
            if c.get("provider") in VALIDATORS:
                attempt("format_rules", f"{t}.{name}", lambda o=o, name=name, p=c["provider"]: (lambda n: ("fail" if n else "pass", {"n_bad": n}))(format_violations(o, name, p).first()[0]))
            attempt("leakage", f"{t}.{name}", lambda s=s, o=o, name=name, st=strategy: (lambda n: ("pass" if not n else "warn" if st in ("shuffle", "categorical", "truncate", "bucketize", "date_shift") else "fail", {"n_leaked": n}))(leakage(s, o, name).first()[0]))
            if key and not set(key) & {name}:
                attempt("null_audit", f"{t}.{name}", lambda s=s, o=o, key=key, name=name: (lambda n: ("fail" if n else "pass", {"n_moved": n}))(null_audit(s, o, key, [name]).first()["n_moved"]))
                if c.get("deterministic", True) and strategy != "shuffle":
                    attempt("determinism_sample", f"{t}.{name}", lambda s=s, o=o, key=key, name=name: (lambda n: ("fail" if n else "pass", {"n_split": n}))(determinism(s, o, key, name).first()[0]))
        for group in spec.get("composites", []):
            attempt("composite_coherence", t, lambda o=o, g=group: (lambda n: ("fail" if n else "pass", {"n_bad": n}))(coherence(o, g["provider"], g["columns"]).first()[0]))
        attempt("sampled_values", t, lambda o=o: ("pass", {"sample": [r.asDict() for r in o.limit(3).collect()]}))
    for r in config.get("relationships", []):
        e = r if isinstance(r, relations.Edge) else relations.Edge(r["parent_table"], tuple(r["parent_columns"]), r["child_table"], tuple(r["child_columns"]), r.get("namespace", ""), r["orphan_policy"])
        if e.parent_table in output and e.child_table in output:
            def fk(e=e):
                n = relations.orphans(output[e.child_table], e.child_columns, [(output[e.parent_table], e.parent_columns)]).count()
                return ("fail" if n and e.orphan_policy == "fail" else "warn" if n and e.orphan_policy == "warn" else "pass"), {"n_orphans": n}

            attempt("fk_validity", e.child_table, fk)
    worst = reduce(lambda a, b: max(a, b, key=("pass", "warn", "error", "fail").index), [c.status for c in checks], "pass")
    return {"status": worst, "checks": [c.__dict__ for c in checks]}


def policy_violations(config: dict, policy: dict) -> list[str]:
    """Columns that the config leaves open though the policy asks for a mask: {require: {table.column: [strategies]}}."""
    have = {f"{t}.{c['name']}": c.get("strategy") for t, s in config.get("tables", {}).items() for c in s.get("columns", [])}
    out = []
    for column, allowed in policy.get("require", {}).items():
        if have.get(column) not in allowed:
            out.append(f"{column}: {have.get(column)} is none of {', '.join(allowed)}")
    if out and policy.get("mode") == "fail":
        raise MaskError("policy_violation", "; ".join(out))
    return out
