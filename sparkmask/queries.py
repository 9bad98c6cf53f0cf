"""The catalogue: a query for each operator over the test tables, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identifiers as ids
from .functions.kernel import Kernel, index_of, integer_bytes, slice_number, sql_index, sql_integer_bytes
from .operators import audit, composite, discovery, generate, profile, quality, relations, strategies, transforms
from .plans.run import run_pipeline

SEED = 20260101
K = Kernel(SEED)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def masked(spark: SparkSession, d: str, table: str, columns: list[dict], keep: list[str], source: DataFrame | None = None, **spec) -> DataFrame:
    df = t(spark, d, table).select(*keep) if source is None else source
    config = {"global_settings": {"seed": SEED}, "tables": {table: {"columns": columns, **spec}}}
    return run_pipeline(spark, config, {table: df}).tables[table]


def key(ns: str, column: str) -> str:
    return K.sql_digest(ns, sql_integer_bytes(column))


def text_key(ns: str, column: str) -> str:
    return K.sql_digest(ns, f"encode({column})")


# --- masks -----------------------------------------------------------------------------------------------------


@query(f"SELECT {key('customer', 'c_custkey')} AS c_custkey, c_mktsegment FROM customer")
def hash_customer(spark, d):
    return masked(spark, d, "customer", [{"name": "c_custkey", "strategy": "hash", "namespace": "customer"}], ["c_custkey", "c_mktsegment"])


@query(f"SELECT c_custkey, substr({text_key('name', 'c_name')}, 1, 16) AS c_name FROM customer")
def hash_truncated(spark, d):
    return masked(spark, d, "customer", [{"name": "c_name", "strategy": "hash", "namespace": "name", "provider_config": {"truncate": 16}}], ["c_custkey", "c_name"])


@query(f"SELECT c_custkey, {sql_index(key('idx', 'c_custkey'), 9973)} AS idx FROM customer")
def derive_index(spark, d):
    return t(spark, d, "customer").select("c_custkey", K.digest("idx", integer_bytes(F.col("c_custkey"))).alias("h")).select("c_custkey", index_of(F.col("h"), 9973).alias("idx"))


@query("SELECT c_custkey, 'XXX' AS c_name FROM customer")
def redact_names(spark, d):
    return masked(spark, d, "customer", [{"name": "c_name", "strategy": "redact", "provider_config": {"redact_with": "XXX"}}], ["c_custkey", "c_name"])


@query("SELECT p_partkey, substr(p_name, 1, 5) AS p_name, right(p_brand, 2) AS p_brand, substr(p_type, 1, 3) || repeat('*', greatest(length(p_type) - 3, 0)) AS p_type FROM part")
def truncate_parts(spark, d):
    cols = [{"name": "p_name", "strategy": "truncate", "provider_config": {"length": 5}}, {"name": "p_brand", "strategy": "truncate", "provider_config": {"length": 2, "keep": "tail"}}, {"name": "p_type", "strategy": "truncate", "provider_config": {"length": 3, "mask_char": "*"}}]
    return masked(spark, d, "part", cols, ["p_partkey", "p_name", "p_brand", "p_type"])


@query("SELECT p_partkey, CAST(CAST(floor(p_size / 10.0) * 10 AS BIGINT) AS VARCHAR) AS p_size, CAST(CAST(floor(p_retailprice / 100.0) * 100 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(p_retailprice / 100.0) * 100 + 99 AS BIGINT) AS VARCHAR) AS p_retailprice FROM part")
def bucketize_parts(spark, d):
    cols = [{"name": "p_size", "strategy": "bucketize", "provider_config": {"width": 10}}, {"name": "p_retailprice", "strategy": "bucketize", "provider_config": {"preset": "by_century", "format": "range"}}]
    return masked(spark, d, "part", cols, ["p_partkey", "p_size", "p_retailprice"])


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_quantity / 10.0) * 10 + 5 AS BIGINT) AS VARCHAR) AS l_quantity FROM lineitem")
def bucketize_midpoint(spark, d):
    return masked(spark, d, "lineitem", [{"name": "l_quantity", "strategy": "bucketize", "provider_config": {"width": 10, "format": "midpoint"}}], ["l_orderkey", "l_linenumber", "l_quantity"])


@query(f"SELECT o_orderkey, list_extract(['red', 'green', 'blue'], {sql_index(text_key('prio', 'o_orderpriority'), 3)} + 1) AS o_orderpriority FROM orders")
def categorical_uniform(spark, d):
    return masked(spark, d, "orders", [{"name": "o_orderpriority", "strategy": "categorical", "namespace": "prio", "provider_config": {"categories": ["red", "green", "blue"]}}], ["o_orderkey", "o_orderpriority"])


@query(f"SELECT o_orderkey, CASE WHEN i < 500000 THEN 'a' WHEN i < 800000 THEN 'b' ELSE 'c' END AS o_custkey FROM (SELECT o_orderkey, {sql_index(key('cust', 'o_custkey'), 1000000)} AS i FROM orders)")
def categorical_weighted(spark, d):
    cols = [{"name": "o_custkey", "strategy": "categorical", "namespace": "cust", "provider_config": {"categories": ["a", "b", "c"], "weights": [5, 3, 2]}}]
    return masked(spark, d, "orders", cols, ["o_orderkey", "o_custkey"])


@query(f"SELECT o_orderkey, strftime(o_orderdate + INTERVAL (n) DAY, '%Y-%m-%d') AS o_orderdate FROM (SELECT o_orderkey, o_orderdate, {sql_index(text_key('dates', "strftime(o_orderdate, '%Y-%m-%d')"), 61)} - 30 AS n FROM orders)")
def date_shift_orders(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    return masked(spark, d, "orders", [{"name": "o_orderdate", "strategy": "date_shift", "namespace": "dates", "provider_config": {"jitter_days": 30}}], [], df)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 'REDACTED' ELSE c_name END AS c_name, c_mktsegment, c_acctbal FROM customer")
def when_gate(spark, d):
    return masked(spark, d, "customer", [{"name": "c_name", "strategy": "redact", "when": "c_mktsegment == 'BUILDING' and c_acctbal > 0"}], ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])


@query("SELECT c_mktsegment FROM customer")
def shuffle_segment(spark, d):
    return masked(spark, d, "customer", [{"name": "c_mktsegment", "strategy": "shuffle", "namespace": "seg"}], ["c_custkey", "c_mktsegment"], row_key=["c_custkey"]).select("c_mktsegment")


@query("SELECT c_custkey, upper(substr(c_name, 1, 3)) || '-' || CAST(length(c_name) AS VARCHAR) AS c_name FROM customer")
def formula_column(spark, d):
    return masked(spark, d, "customer", [{"name": "c_name", "strategy": "formula", "provider_config": {"formula": "value[:3].upper() + '-' + str(len(value))"}}], ["c_custkey", "c_name"])


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS again, length(CAST(c_custkey AS VARCHAR)) AS n FROM customer")
def fpe_roundtrip(spark, d):
    from .functions.fpe import fpe_column

    ctx = strategies.Context(K, "c_custkey", "fpe", {"charset": "digits"})
    df = t(spark, d, "customer").select("c_custkey", fpe_column(F.col("c_custkey"), strategies.cipher(ctx)).alias("e"))
    return df.select("c_custkey", fpe_column(F.col("e"), strategies.cipher(ctx), -1).alias("again"), F.length("e").cast("long").alias("n"))


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS text FROM documents")
def text_redact_email(spark, d):
    return masked(spark, d, "documents", [{"name": "text", "strategy": "text_redact", "provider_config": {"detectors": ["email"], "label_token": True}}], ["doc_id", "text"])


@query()
def text_redact_all(spark, d):
    return masked(spark, d, "documents", [{"name": "text", "strategy": "text_redact", "provider_config": {"label_token": True}}], ["doc_id", "text"])


@query(f"SELECT event_id, {text_key('k', "json_extract_string(props, '$.k')")} AS k FROM events")
def nested_json(spark, d):
    out = masked(spark, d, "events", [{"name": "props", "strategy": "nested", "provider_config": {"target": "$.k", "strategy": "hash"}, "namespace": "k"}], ["event_id", "props"])
    return out.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"WITH x AS (SELECT n_nationkey, {text_key('n', 'n_name')} AS h FROM nation) SELECT n_nationkey, h AS name, n_nationkey AS code FROM x")
def nested_struct(spark, d):
    df = t(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code")).alias("s"))
    out = masked(spark, d, "nation", [{"name": "s", "strategy": "nested", "namespace": "n", "provider_config": {"target": "$.name", "strategy": "hash"}}], [], df)
    return out.select("n_nationkey", F.col("s.name").alias("name"), F.col("s.code").alias("code"))


@query("SELECT count(*) AS n, count(DISTINCT c_nationkey) AS n_source, count(DISTINCT c_nationkey) AS n_masked FROM customer")
def faker_match_cardinality(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_nationkey").cast("string").alias("name"))
    out = masked(spark, d, "customer", [{"name": "name", "strategy": "faker", "provider": "person_full_name", "namespace": "p", "cardinality_mode": "match_source_cardinality", "pool_size": 500}], [], df)
    return out.agg(F.count("name").alias("n"), F.count_distinct("c_nationkey").alias("n_source"), F.count_distinct("name").alias("n_masked"))


@query("SELECT count(*) AS n, count(*) AS n_masked FROM nation")
def faker_unique(spark, d):
    out = masked(spark, d, "nation", [{"name": "n_name", "strategy": "faker", "provider": "person_email", "namespace": "u", "cardinality_mode": "unique", "pool_size": 400}], ["n_nationkey", "n_name"], row_key=["n_nationkey"])
    return out.agg(F.count("n_name").alias("n"), F.count_distinct("n_name").alias("n_masked"))


FULL_NAMES = strategies.pool_of(strategies.Context(K, "c_name", "p", {}, True, "person_full_name", False, 2000, None, ()), "person_full_name")


@query(f"SELECT c_custkey, [{', '.join(repr(x) for x in FULL_NAMES)}][1 + {sql_index(text_key('p', 'c_name'), len(FULL_NAMES))}] AS c_name FROM customer")
def faker_reuse(spark, d):
    return masked(spark, d, "customer", [{"name": "c_name", "strategy": "faker", "provider": "person_full_name", "namespace": "p", "pool_size": 2000}], ["c_custkey", "c_name"])


# --- identifiers: digests sliced in SQL too, then validated ------------------------------------------------------


def digests(spark, d) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", K.digest("id", integer_bytes(F.col("c_custkey"))).alias("h"))


HD = f"(SELECT c_custkey, {key('id', 'c_custkey')} AS h FROM customer)"


def sql_number(first: int, n: int) -> str:
    return f"CAST('0x' || substr(h, {2 * first + 1}, {2 * n}) AS UBIGINT)"


@query(f"SELECT c_custkey, lpad(CAST(a % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(b % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS ndc FROM (SELECT c_custkey, {sql_number(0, 4)} AS a, {sql_number(4, 4)} AS b, {sql_number(8, 4)} AS c FROM {HD})")
def identifier_ndc(spark, d):
    return digests(spark, d).select("c_custkey", ids.ndc(F.col("h")).alias("ndc"))


@query(f"SELECT c_custkey, CASE WHEN starts_with(m, '0') THEN '1' || substr(m, 2) ELSE m END AS mrn FROM (SELECT c_custkey, lpad(CAST({sql_number(0, 8)} % 100000000 AS VARCHAR), 8, '0') AS m FROM {HD})")
def identifier_mrn(spark, d):
    return digests(spark, d).select("c_custkey", ids.mrn(F.col("h")).alias("mrn"))


@query(f"SELECT c_custkey, substr(s, 1, 3) || '-' || substr(s, 4, 2) || '-' || substr(s, 6) AS ssn FROM (SELECT c_custkey, list_filter([{', '.join(f"lpad(CAST({sql_number(i, 8)} % 1000000000 AS VARCHAR), 9, '0')" for i in (0, 8, 16, 24))}], lambda x: NOT (substr(x, 1, 3) IN ('000', '666') OR x[1] = '9' OR substr(x, 4, 2) = '00' OR substr(x, 6) = '0000'))[1] AS s FROM {HD})")
def identifier_ssn(spark, d):
    return digests(spark, d).select("c_custkey", ids.ssn(F.col("h")).alias("ssn"))


@query(f"SELECT c_custkey, c || lpad(CAST({sql_number(1, 2)} % (hi - lo + 1) + lo AS VARCHAR), 2, '0') || '.' || CAST({sql_number(3, 1)} % 10 AS VARCHAR) AS icd10 FROM (SELECT *, CASE c {' '.join(f"WHEN '{a}' THEN {b}" for a, b in ids.ICD10_LAST.items())} ELSE 99 END AS hi, CASE c WHEN 'F' THEN 1 ELSE 0 END AS lo FROM (SELECT c_custkey, h, chr(CAST(65 + {sql_number(0, 1)} % 26 AS INT)) AS c FROM {HD}))")
def identifier_icd10(spark, d):
    return digests(spark, d).select("c_custkey", ids.icd10(F.col("h")).alias("icd10"))


@query("SELECT count(*) AS n, count(*) AS ssn, count(*) AS ein, count(*) AS npi, count(*) AS pan, count(*) AS icd10, count(*) AS iban, count(*) AS cusip, count(*) AS mrn, count(*) AS ndc FROM customer")
def identifiers_valid(spark, d):
    df = digests(spark, d)
    for k, f in ids.IDENTIFIERS.items():
        df = df.withColumn(k, f(F.col("h")))
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(ids.VALIDATORS[k](F.col(k))).alias(k.removeprefix("synthetic_")) for k in ids.IDENTIFIERS])


@query("SELECT count(*) AS n, 0 AS bad_email, 0 AS bad_place FROM customer")
def composites_coherent(spark, d):
    df = digests(spark, d)
    person, place = composite.bundle(F.col("h"), "composite_person"), composite.bundle(F.col("h"), "composite_address")
    df = df.select(*[v.alias(k) for k, v in {**person, **place}.items()])
    a = audit.coherence(df, "composite_person", {k: k for k in person}).select(F.col("n_bad").alias("bad_email"))
    b = audit.coherence(df, "composite_address", {k: k for k in place}).select(F.col("n_bad").alias("bad_place"))
    return df.agg(F.count(F.lit(1)).alias("n")).crossJoin(a).crossJoin(b)  # one row each


# --- foreign keys -------------------------------------------------------------------------------------------------


def fk_config(policy: str, child: str = "orders", ck: str = "o_custkey") -> dict:
    return {
        "global_settings": {"seed": SEED},
        "tables": {"customer": {"columns": [{"name": "c_custkey", "strategy": "hash", "namespace": "cid"}]}, child: {"columns": []}},
        "relationships": [{"parent_table": "customer", "parent_columns": ["c_custkey"], "child_table": child, "child_columns": [ck], "namespace": "cid", "orphan_policy": policy}],
    }


def fk_tables(spark, d) -> dict[str, DataFrame]:
    """Customers without every seventh, so that orders have orphans, and orders with some null keys."""
    o = t(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_custkey, 8)").alias("o_custkey"), "o_totalprice")
    return {"customer": t(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_mktsegment"), "orders": o}


FK = f"(SELECT o_orderkey, nullif(o_custkey, 8) AS k, o_totalprice, {key('cid', 'nullif(o_custkey, 8)')} AS h FROM orders) o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) c ON o.k = c.c_custkey"


@query(f"SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN h ELSE CAST(k AS VARCHAR) END AS o_custkey FROM {FK}")
def fk_preserve_orders(spark, d):
    return run_pipeline(spark, fk_config("preserve"), fk_tables(spark, d)).tables["orders"].select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, CASE WHEN k IS NOT NULL THEN h END AS o_custkey FROM {FK}")
def fk_remap_orders(spark, d):
    return run_pipeline(spark, fk_config("remap"), fk_tables(spark, d)).tables["orders"].select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, nullif(o_custkey, 8) AS o_custkey FROM orders WHERE nullif(o_custkey, 8) IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_orphans(spark, d):
    s = fk_tables(spark, d)
    return relations.orphans(s["orders"], ("o_custkey",), [(s["customer"], ("c_custkey",))]).select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN {key('cid', 'o_custkey')} ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fk_gated_parent(spark, d):
    """The parent's `when` decides which keys change, in the children as in the parent."""
    config = fk_config("preserve")
    config["tables"]["customer"]["columns"][0]["when"] = "c_mktsegment == 'BUILDING'"
    s = {"customer": t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "orders": t(spark, d, "orders").select("o_orderkey", "o_custkey")}
    return run_pipeline(spark, config, s).tables["orders"]


@query(f"SELECT s_suppkey, {text_key('nn', "n_name || 'é'")} AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def fk_unnormalised(spark, d):
    """Keys with decomposed letters: parent and child get the digest of the composed form."""
    n = t(spark, d, "nation").select(F.concat("n_name", F.lit("e\u0301")).alias("name"), "n_nationkey")
    s = t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("name").alias("nation"))
    config = {
        "global_settings": {"seed": SEED},
        "tables": {"nation": {"columns": [{"name": "name", "strategy": "hash", "namespace": "nn"}]}, "supplier": {"columns": []}},
        "relationships": [{"parent_table": "nation", "parent_columns": ["name"], "child_table": "supplier", "child_columns": ["nation"], "namespace": "nn", "orphan_policy": "remap"}],
    }
    out = run_pipeline(spark, config, {"nation": n.select("name"), "supplier": s}).tables
    return out["supplier"].join(out["nation"], F.col("nation") == F.col("name"), "left_semi")


@query(f"SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_keys, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM (SELECT {key('cid', 'o_custkey')} AS o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))")
def fk_join_after_mask(spark, d):
    s = {"customer": t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "orders": t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")}
    out = run_pipeline(spark, fk_config("preserve"), s).tables
    j = out["orders"].join(out["customer"], out["orders"]["o_custkey"] == out["customer"]["c_custkey"])
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_keys"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total"))


@query(f"SELECT n_nationkey, coalesce({key('a', 'a')}, {key('b', 'b')}, CAST(n_nationkey AS VARCHAR)) AS masked FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey AS a FROM customer WHERE c_nationkey < 10) ON n_nationkey = a LEFT JOIN (SELECT DISTINCT s_nationkey AS b FROM supplier) ON n_nationkey = b")
def fk_multi_parent(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").alias("masked"))
    a = t(spark, d, "customer").where("c_nationkey < 10").select("c_nationkey")
    b = t(spark, d, "supplier").select("s_nationkey")
    maps = [relations.key_map(a, {"c_nationkey": K.digest("a", integer_bytes(F.col("c_nationkey")))}, ("c_nationkey",)), relations.key_map(b, {"s_nationkey": K.digest("b", integer_bytes(F.col("s_nationkey")))}, ("s_nationkey",))]
    return relations.resolve(n, ("masked",), maps, "preserve")


@query(f"WITH e AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey / 2 AS BIGINT) END AS boss FROM orders) SELECT e.id, CASE WHEN p.id IS NOT NULL THEN {key('emp', 'e.boss')} ELSE CAST(e.boss AS VARCHAR) END AS boss FROM e LEFT JOIN e p ON e.boss = p.id".replace("CAST(o_orderkey / 2 AS BIGINT)", "o_orderkey // 2"))
def fk_self(spark, d):
    e = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("if(o_orderkey % 5 = 0, null, o_orderkey div 2)").alias("boss"))
    m = relations.key_map(e, {"id": K.digest("emp", integer_bytes(F.col("id")))}, ("id",))
    return relations.resolve(e, ("boss",), [m], "preserve")


@query(f"SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN p.a IS NOT NULL THEN {key('ord', 'l_orderkey')} ELSE CAST(l_orderkey AS VARCHAR) END AS l_orderkey FROM lineitem LEFT JOIN (SELECT DISTINCT l_orderkey AS a, l_linenumber AS b FROM lineitem WHERE l_quantity < 25) p ON l_orderkey = a AND l_linenumber = b")
def fk_composite_key(spark, d):
    line = t(spark, d, "lineitem")
    m = relations.key_map(line.where("l_quantity < 25"), {"l_orderkey": K.digest("ord", integer_bytes(F.col("l_orderkey")))}, ("l_orderkey", "l_linenumber"))
    child = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_orderkey", "l_linenumber")
    return relations.resolve(child, ("l_orderkey", "l_linenumber"), [m], "preserve").select("k", "n", "l_orderkey")


# --- transforms -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS gross FROM lineitem WHERE (l_quantity >= 10 AND l_returnflag IN ('A', 'R')) OR NOT l_linestatus = 'O'")
def transform_filter_derive(spark, d):
    steps = [{"op": "filter", "expression": "(l_quantity >= 10 and l_returnflag in ['A', 'R']) or not l_linestatus == 'O'"}, {"op": "derive", "column": "gross", "expression": "l_quantity * l_extendedprice"}]
    return transforms.apply_transforms(t(spark, d, "lineitem"), steps).select("l_orderkey", "l_linenumber", "gross")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def transform_sort_limit(spark, d):
    steps = [{"op": "sort", "by": ["o_totalprice"], "ascending": False}, {"op": "limit", "n": 100}, {"op": "drop_column", "columns": ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]}]
    return transforms.apply_transforms(t(spark, d, "orders"), steps, "o_orderkey")


@query("SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def transform_dedupe(spark, d):
    df = t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return transforms.dedupe(df, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def transform_distinct(spark, d):
    return transforms.dedupe(t(spark, d, "lineitem").select("l_returnflag", "l_linestatus"))


# --- guarded SQL ------------------------------------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")
DISCOVERY = {
    "aggregate": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, round(max(l_extendedprice), 2) AS top FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "join_inner": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS na, b.n AS nb FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_range": "SELECT p_partkey, r_regionkey FROM part JOIN region ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 9",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "having_filter": "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    "window_rank": "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS s FROM orders",
    "window_frame": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "window_ntile": "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_suppkey) AS q, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS f FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k, 'c' AS src FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 500000) SELECT c_mktsegment, count(*) AS n FROM top JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "subquery_scalar": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)",
    "subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "in_list": "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)",
    "case_when": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer",
    "top_k": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
    "values": "VALUES (1, 'a'), (2, 'b')",
    "strings": "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, substr(c_name, 2, 4) AS s, replace(c_name, '0', 'o') AS r, concat(c_mktsegment, '!') AS c FROM customer",
    "dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders",
    "distinct_aggregate": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus",
}


def discover(name: str):
    def run(spark, d):
        # the catalogue compares whole results: the row limit of interactive use is lifted
        return discovery.run_sql(spark, DISCOVERY[name], {x: f"{d}/{x}.parquet" for x in TABLES}, 2**31 - 1)

    return run


for _name, _sql in DISCOVERY.items():
    QUERIES[f"discovery_{_name}"] = discover(_name)
    SQL[f"discovery_{_name}"] = _sql if _name != "values" else "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(col1, col2)"


# --- profiles and metrics -------------------------------------------------------------------------------------------------

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ORDER_COLUMNS))
def profile_counts(spark, d):
    return profile.counts(t(spark, d, "orders").select(*ORDER_COLUMNS))


@query("SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{int(100 * q):02d}" for q in profile.QUANTILES) + " FROM lineitem")
def quantiles(spark, d):
    s = profile.numeric_stats(t(spark, d, "lineitem"), "l_extendedprice")
    return s.select("n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", *[F.round(f"p{int(100 * q):02d}", 6).alias(f"p{int(100 * q):02d}") for q in profile.QUANTILES])


@query("WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM part, e GROUP BY 1")
def histogram_numeric(spark, d):
    return profile.histogram(t(spark, d, "part"), "p_retailprice").select("bin", "n")


@query("WITH c AS (SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1), h AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 20) SELECT * FROM h UNION ALL SELECT NULL, (SELECT sum(n) FROM c)::BIGINT - (SELECT sum(n) FROM h)::BIGINT")
def topk_values(spark, d):
    return profile.top_values(t(spark, d, "part"), "p_size")


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_bins(spark, d):
    return profile.year_bins(t(spark, d, "orders"), "o_orderdate")


@query("SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 25")
def crosstab(spark, d):
    return profile.crosstab(t(spark, d, "labels"), "quality", "toxic")


@query("SELECT CASE WHEN length(c_name) < 20 THEN '<20' WHEN length(c_name) < 50 THEN '20-50' WHEN length(c_name) < 100 THEN '50-100' ELSE '>100' END AS bucket, count(*) AS n, min(length(c_name)) AS min_length, max(length(c_name)) AS max_length FROM customer GROUP BY 1")
def length_hist(spark, d):
    return profile.length_bins(t(spark, d, "customer"), "c_name")


QUASI = ("p_brand", "p_type", "p_size")
_K2 = [("p_brand", "p_type"), ("p_brand", "p_size"), ("p_type", "p_size"), QUASI]


@query(" UNION ALL ".join(f"SELECT '{','.join(c)}' AS columns, min(n) AS k, count(*) AS n_groups FROM (SELECT count(*) AS n FROM part GROUP BY {', '.join(c)})" for c in _K2))
def k_anonymity(spark, d):
    return profile.k_anonymity(t(spark, d, "part"), list(QUASI))


@query(r"""SELECT 'text' AS "column", 'url' AS detector, count(text) AS n, count(*) FILTER (WHERE regexp_full_match(trim(text), 'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]{4,}')) AS n_match FROM (SELECT url AS text FROM pages)""")
def detector_rates(spark, d):
    return profile.detector_rates(t(spark, d, "pages").select(F.col("url").alias("text")), ["text"], ["url"]).select("column", "detector", "n", "n_match")


@query("SELECT 'v' AS \"column\", s AS sentinel, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN ' unknown ' WHEN 2 THEN c_name ELSE '1900-01-01' END AS v FROM customer), (VALUES ('n/a'), ('unknown')) x(s) WHERE lower(trim(v)) = s GROUP BY s UNION ALL SELECT 'v', '1900-01-01', count(*) FROM customer WHERE c_custkey % 4 = 3")
def sentinels(spark, d):
    v = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN ' unknown ' WHEN 2 THEN c_name ELSE '1900-01-01' END")
    return profile.sentinels(t(spark, d, "customer").select(v.alias("v")))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_new FROM orders")
def new_row_synthesis(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))
    return quality.new_rows(o, out).select("n_rows", "n_new")


@query("SELECT s_suppkey, round(min((abs(s_acctbal - c_acctbal) / r + CASE WHEN s_nationkey = c_nationkey THEN 0.0 ELSE 1.0 END) / 2), 9) AS distance FROM supplier, customer, (SELECT max(c_acctbal) - min(c_acctbal) AS r FROM customer) GROUP BY s_suppkey")
def dcr_gower(spark, d):
    c = t(spark, d, "customer").select(F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    return quality.nearest(c, s, ["bal"], ["nation"], cap=None, key="s_suppkey").select("s_suppkey", F.round(F.least("distance", F.lit(1.0)), 9).alias("distance"))


@query("SELECT count(*) - count(DISTINCT o_custkey) AS n_duplicates FROM orders")
def pk_duplicates(spark, d):
    return audit.pk_duplicates(t(spark, d, "orders"), ["o_custkey"])


@query("SELECT 'o_orderstatus' AS \"column\", count(*) AS n_moved FROM orders WHERE o_orderkey % 11 = 0")
def null_audit(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return audit.null_audit(o, out, ["o_orderkey"], ["o_orderstatus"])


@query("SELECT count(*) AS n_leaked FROM customer WHERE c_custkey % 3 = 0")
def leakage(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return audit.leakage(c, c.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("~"), F.col("c_name")))), "c_name")


@query("SELECT count(*) AS n_split FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus))")
def determinism_audit(spark, d):
    o = t(spark, d, "orders")
    return audit.determinism(o.select("o_orderkey", F.col("o_custkey").alias("v")), o.select("o_orderkey", F.col("o_orderstatus").alias("v")), ["o_orderkey"], "v")


# --- generation -------------------------------------------------------------------------------------------------------------


@query("SELECT 'ID-' || lpad(CAST(100 + 3 * range AS VARCHAR), 6, '0') AS id FROM range(1000)")
def gen_sequence(spark, d):
    return generate.generate_table(spark, "g", 1000, {"id": {"type": "sequence", "start": 100, "step": 3, "pad": 6, "prefix": "ID-"}}, K)


@query("WITH p AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) SELECT CAST(g.range AS VARCHAR) AS id, p.k AS nation FROM range(500) g JOIN p ON g.range % 25 = p.r")
def gen_reference_sequential(spark, d):
    return generate.generate_table(spark, "g", 500, {"id": {"type": "sequence", "start": 0}, "nation": {"type": "reference", "table": "nation", "column": "n_nationkey", "mode": "sequential"}}, K, {"nation": t(spark, d, "nation")})


_GD = K.sql_digest("gen/g/tier", sql_integer_bytes("range"))


@query(f"SELECT CAST(range AS VARCHAR) AS id, CASE WHEN s < 600000 THEN 'gold' WHEN s < 900000 THEN 'silver' ELSE 'basic' END AS tier FROM (SELECT range, ((CAST('0x' || substr(h, 1, 12) AS UBIGINT) % 1000000) * (65536 % 1000000) + CAST('0x' || substr(h, 13, 4) AS UBIGINT)) % 1000000 AS s FROM (SELECT range, {_GD} AS h FROM range(800)))")
def gen_categorical(spark, d):
    return generate.generate_table(spark, "g", 800, {"id": {"type": "sequence", "start": 0}, "tier": {"type": "categorical", "categories": ["gold", "silver", "basic"], "weights": [6, 3, 1]}}, K)


@query()
def gen_statistical(spark, d):
    snap = quality.snapshot(t(spark, d, "customer").select("c_acctbal", "c_mktsegment"))
    cols = {"id": {"type": "sequence"}, "bal": {"type": "statistical", "snapshot": snap, "column": "c_acctbal"}, "segment": {"type": "statistical", "snapshot": snap, "column": "c_mktsegment", "allow_real_categories": True, "null_probability": 0.1}}
    return generate.generate_table(spark, "g", 2000, cols, K)


@query("SELECT CAST(range AS VARCHAR) AS id, 2 * range + 1 AS odd FROM range(300)")
def gen_formula(spark, d):
    return generate.generate_table(spark, "g", 300, {"id": {"type": "sequence", "start": 0}, "odd": {"type": "formula", "formula": "2 * i + 1"}}, K)


# --- streams -------------------------------------------------------------------------------------------------------------------


def streamed(spark, d, column: dict):
    """The stream of the events file, masked and run to its end into a table in the shared folder."""
    import uuid

    from .plans.compile import compile_plan
    from .streaming.masks import mask_stream

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "user_id", "event_type")
    plan = compile_plan({"global_settings": {"seed": SEED}, "tables": {"events": {"columns": [column]}}})
    run = mask_stream(plan, "events", stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(f"SELECT event_id, {key('user', 'user_id')} AS user_id, event_type FROM events")
def stream_mask_events(spark, d):
    return streamed(spark, d, {"name": "user_id", "strategy": "hash", "namespace": "user"})


@query(f"SELECT event_id, CASE WHEN event_type = 'click' THEN {key('user', 'user_id')} ELSE CAST(user_id AS VARCHAR) END AS user_id, event_type FROM events")
def stream_when(spark, d):
    """A stream keeps the rows that `when` leaves alone."""
    return streamed(spark, d, {"name": "user_id", "strategy": "hash", "namespace": "user", "when": "event_type == 'click'"})


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    from .streaming.masks import tumbling

    return tumbling(t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value").withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


# --- flagship --------------------------------------------------------------------------------------------------------------------


@query(f"SELECT c_mktsegment, c_acctbal, n, total FROM (SELECT {key('cid', 'c_custkey')} AS k, c_mktsegment, CAST(CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) AS VARCHAR) AS c_acctbal, count(*) AS n, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_acctbal)")
def flagship(spark, d):
    """Customers and orders masked with their references intact, joined and summed in the order of the orders' keys.

    Sums of doubles depend on their order, and half a unit decides what they are rounded to: a window adds row by row,
    whatever the partitions, and spills.
    """
    config = fk_config("preserve")
    config["tables"]["customer"]["columns"] += [{"name": "c_name", "strategy": "redact"}, {"name": "c_acctbal", "strategy": "bucketize", "provider_config": {"width": 1000}}]
    s = {"customer": t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "orders": t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")}
    out = run_pipeline(spark, config, s).tables
    j = out["orders"].join(out["customer"], out["orders"]["o_custkey"] == out["customer"]["c_custkey"])
    w = Window.partitionBy("c_custkey", "c_mktsegment", "c_acctbal").orderBy("o_orderkey", "o_totalprice")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = j.select("c_mktsegment", "c_acctbal", F.count(F.lit(1)).over(so_far).alias("n"), F.sum("o_totalprice").over(so_far).alias("total"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    return sums.where("last").select("c_mktsegment", "c_acctbal", "n", F.round("total", 0).cast("long").alias("total"))


def derived_key(column: str, ns: str):
    return K.digest(ns, integer_bytes(F.col(column))), slice_number
