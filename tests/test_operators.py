import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmask.errors import MaskError
from sparkmask.functions import detectors
from sparkmask.functions.detectors import spans
from sparkmask.functions.expressions import column_expression
from sparkmask.operators import audit, discovery, generate, profile, quality, relations, transforms, vault, walks
from sparkmask.plans.compile import Plan, compile_plan, streamable, validate
from sparkmask.plans.run import context, run_pipeline


def config(columns, table="t", **more):
    return {"global_settings": {"seed": 5}, "tables": {table: {"columns": columns, **more}}}


@pytest.fixture
def people(spark):
    rows = [(1, "Ann Lee", "ann@x.org", "2020-01-31", 10, None), (2, "Bob", None, "2021-02-28", None, "a"), (3, None, "c@x.org", "bad", 35, "b"), (4, "Ann Lee", "ann@x.org", "2019-12-31", -7, "a")]
    return spark.createDataFrame(rows, "id int, name string, email string, day string, n int, tag string")


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_masks_keep_nulls_and_ignore_partitions(spark, people, parts):
    cols = [
        {"name": "name", "strategy": "hash", "namespace": "a"},
        {"name": "email", "strategy": "faker", "provider": "person_email", "namespace": "a"},
        {"name": "day", "strategy": "date_shift", "namespace": "a", "provider_config": {"date_format": "%Y-%m-%d", "jitter_days": 5}},
        {"name": "n", "strategy": "bucketize", "provider_config": {"width": 10}},
        {"name": "tag", "strategy": "categorical", "namespace": "a", "provider_config": {"categories": ["x", "y"], "weights": [1, 1]}},
    ]
    out = run_pipeline(spark, config(cols), {"t": people.repartition(parts)}).tables["t"]
    once = run_pipeline(spark, config(cols), {"t": people}).tables["t"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    for c in ("name", "email", "n", "tag"):
        assert [v is None for v in values(out, c)] == [v is None for v in values(people, c)]
    assert values(out, "name")[0] == values(out, "name")[3] and values(out, "day")[2] == "bad"
    assert values(out, "n") == ["10", None, "30", "-10"]


def test_bucketize_formats(spark):
    df = spark.createDataFrame([(1, 12.5), (2, -3.0), (3, None)], "id int, x double")
    run = lambda o: values(run_pipeline(spark, config([{"name": "x", "strategy": "bucketize", "provider_config": o}]), {"t": df}).tables["t"], "x")
    assert run({"width": 5, "format": "range"}) == ["10-14", "-5--1", None]
    assert run({"width": 5, "format": "midpoint"}) == ["12.5", "-2.5", None]
    assert run({"width": 2.5}) == ["12.5", "-5.0", None]
    assert run({"width": 0}) == run({"width": True})


def test_shuffle_permutes(spark):
    df = spark.range(200).selectExpr("id", "if(id % 10 = 0, null, cast(id as string)) as v")
    out = run_pipeline(spark, config([{"name": "v", "strategy": "shuffle", "namespace": "s"}], row_key=["id"]), {"t": df}).tables["t"]
    a, b = values(df, "v"), values(out, "v")
    assert sorted(filter(None, a)) == sorted(filter(None, b)) and a != b
    assert [x is None for x in a] == [x is None for x in b]
    again = run_pipeline(spark, config([{"name": "v", "strategy": "shuffle", "namespace": "s"}], row_key=["id"]), {"t": df.repartition(7)}).tables["t"]
    assert values(again, "v") == b


def test_pool_modes(spark):
    df = spark.range(60).selectExpr("id", "cast(id % 12 as string) as v")
    base = {"name": "v", "strategy": "faker", "provider": "person_email", "namespace": "p", "pool_size": 300}
    out = run_pipeline(spark, config([base | {"cardinality_mode": "match_source_cardinality"}], row_key=["id"]), {"t": df}).tables["t"]
    pairs = set(zip(values(df, "v"), values(out, "v"), strict=True))
    assert len(pairs) == 12 and len({b for _, b in pairs}) == 12
    out = run_pipeline(spark, config([base | {"cardinality_mode": "unique"}], row_key=["id"]), {"t": df}).tables["t"]
    assert len(set(values(out, "v"))) == 60
    with pytest.raises(MaskError, match="uniqueness_impossible"):
        run_pipeline(spark, config([base | {"cardinality_mode": "unique", "pool_size": 20}], row_key=["id"]), {"t": df})


def test_composite_fits(spark, people):
    cols = [{"name": "name", "strategy": "composite", "provider": "composite_name_email", "namespace": "n", "coherent_with": ["email"]}]
    out = run_pipeline(spark, config(cols), {"t": people}).tables["t"]
    for r in out.collect():
        assert (r.name is None and r.email is None) or r.email.split("@")[0] == r.name.lower().replace(" ", ".")


@pytest.mark.parametrize("policy", ["preserve", "remap", "warn", "fail"])
def test_orphans(spark, policy):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, 1), (2, 2), (3, 9), (4, None)], "id int, p int")
    c = {"tables": {"p": {"columns": [{"name": "id", "strategy": "hash", "namespace": "k"}]}, "c": {}}, "relationships": [{"parent_table": "p", "parent_columns": ["id"], "child_table": "c", "child_columns": ["p"], "orphan_policy": policy}]}
    if policy == "fail":
        with pytest.raises(MaskError, match="orphan_fk"):
            run_pipeline(spark, c, {"p": parents, "c": kids})
        return
    r = run_pipeline(spark, c, {"p": parents, "c": kids})
    got = values(r.tables["c"], "p")
    keys = [x.id for x in r.tables["p"].collect()]
    assert set(got[:2]) == set(keys) and got[3] is None
    assert (len(got[2]) == 64) if policy == "remap" else got[2] == "9"
    assert bool(r.warnings) == (policy == "warn")


def test_graph():
    e = lambda a, b: relations.Edge(a, ("id",), b, ("x",), "", "preserve")
    assert relations.Graph([e("a", "b"), e("b", "c"), e("a", "a")]).order == ["a", "b", "c"]
    with pytest.raises(MaskError, match="fk_cycle"):
        relations.Graph([e("a", "b"), e("b", "a")])


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"strategy": "nope"}, "unknown_strategy"), ({"strategy": "faker", "provider": "nope"}, "unknown_provider"), ({"strategy": "faker", "provider": "uuid", "namespace": "n"}, "non_poolable_provider_with_pool_backend"),
        ({"strategy": "hash"}, "deterministic_namespace_missing"), ({"strategy": "text_redact", "provider_config": {"ner": True}}, "ner_unavailable"), ({"strategy": "redact", "typo": 1}, "config_invalid"),
        ({"strategy": "composite", "provider": "composite_person", "namespace": "n"}, "composite_wiring_inconsistent"),
    ],
)
def test_compile_checks(change, code):
    assert validate(config([{"name": "x"} | change]))[0].startswith(code)


def test_plan_round_trip():
    plan = compile_plan(config([{"name": "x", "strategy": "hash", "namespace": "n"}]))
    again = Plan.from_yaml(plan.to_yaml())
    assert again.config_hash == plan.config_hash and again.seed == plan.seed and streamable(plan, "t")


def test_transforms(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, None, 1), (3, "a", None), (4, "a", 3)], "id int, c string, n int")
    steps = [{"op": "dedupe", "columns": ["c", "n"]}, {"op": "sort", "by": "n", "ascending": False}, {"op": "derive", "column": "m", "expression": "n + 1"}, {"op": "drop_column", "columns": ["c"]}]
    got = transforms.apply_transforms(df, steps, "id").collect()
    assert [(r.id, r.m) for r in got] == [(1, 4), (2, 2), (3, None)]
    for bad, code in (({"op": "filter", "expression": "n + 1"}, "filter_expression_not_boolean"), ({"op": "filter", "expression": "zz > 1"}, "expression_refused"), ({"op": "sort", "by": "zz"}, "sort_column_missing"), ({"op": "derive", "column": "c", "expression": "1"}, "derive_column_exists")):
        with pytest.raises(MaskError, match=code):
            transforms.apply_transforms(df, [bad], "id")


@pytest.mark.parametrize("text", ["__import__('os')", "(lambda: 1)()", "c.__class__", "@x > 1", "[x for x in c]", "open('f')", "exec('1')", "c.rename()"])
def test_expressions_refuse(spark, text):
    with pytest.raises(MaskError):
        column_expression(text, ["c"])


def test_expressions(spark):
    df = spark.createDataFrame([("Hello", 7, -2.5)], "s string, n int, x double")
    for text, want in (("s[1:3]", "el"), ("s[-2:]", "lo"), ("s.upper() + '!'", "HELLO!"), ("re.sub('l+', 'L', s)", "HeLo"), ("n // 2", 3), ("-n // 2", -4), ("n % 4 == 3 and x < 0", True), ("'big' if n > 5 else 'small'", "big"), ("len(s) in [4, 5]", True), ("round(x)", -2.0), ("int(x)", -2), ("1 < n < 9", True)):
        assert df.select(column_expression(text, df.columns).alias("v")).first().v == want, text


@pytest.mark.parametrize("sql", ["", "DELETE FROM a", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "SELECT * FROM '/x.parquet'", "SELECT read_csv('x')", "CREATE TABLE x AS SELECT 1", "SELECT java_method('a', 'b')", "SET x = 1", "SELECT * FROM other"])
def test_sql_refused(spark, sql):
    with pytest.raises(MaskError):
        discovery.run_sql(spark, sql, {"a": spark.range(3)})


def test_sql(spark):
    got = discovery.rows(discovery.run_sql(spark, "-- all\nWITH x AS (SELECT id FROM a) SELECT sum(id) AS s, ';' AS t FROM x /* done */;", {"a": spark.range(4)}))
    assert got == [{"s": 6, "t": ";"}]
    assert len(discovery.rows(discovery.run_sql(spark, "SELECT * FROM a", {"a": spark.range(50)}, 7))) == 7


def test_nested(spark):
    rows = [(1, json.dumps({"u": [{"e": "a@b.co", "n": 1}, {"e": "c@d.co"}]})), (2, "not json"), (3, None)]
    df = spark.createDataFrame(rows, "id int, j string")
    out = run_pipeline(spark, config([{"name": "j", "strategy": "nested", "provider_config": {"target": "$.u[*].e", "strategy": "redact"}}]), {"t": df}).tables["t"]
    got = values(out, "j")
    assert json.loads(got[0]) == {"u": [{"e": "REDACTED", "n": 1}, {"e": "REDACTED"}]} and got[1:] == ["not json", None]


def test_spans():
    text = "mail a.b@x.org or 415-555-0123, card 4111 1111 1111 1111, not 4111 1111 1111 1112."
    assert [(d, text[a:b]) for a, b, d in spans(text, ["email", "us_phone", "pan"])] == [("email", "a.b@x.org"), ("us_phone", "415-555-0123"), ("pan", "4111 1111 1111 1111")]


def test_profile(spark):
    df = spark.createDataFrame([(i, f"u{i}@x.org", "N/A" if i % 4 == 0 else "z", i % 3) for i in range(40)], "id int, email string, note string, g int")
    p = profile.run_profile(df, quasi=["note", "g"])
    assert p["columns"]["email"]["detectors"][0]["detector"] == "email" and p["columns"]["note"]["sentinels"] == [{"sentinel": "n/a", "n": 10}]
    assert p["k_anonymity"][0]["k"] == 3 and p["n_rows"] == 40


def test_quality(spark):
    a = spark.range(100).selectExpr("id", "cast(id % 3 as string) as c", "cast(id as double) as x")
    s = quality.snapshot(a, [("c", "id")])
    r = quality.report(s, s)
    assert r["grade"] == "A" and r["fidelity"]["overall_score"] == 1.0 and r["diagnostic"]["row_parity"]
    noisy = quality.dp_noise(quality.snapshot(a), 1.0, 3)
    assert "quantiles" not in noisy["columns"]["x"]["stats"] and quality.dp_noise(quality.snapshot(a), 1.0, 3) == noisy
    with pytest.raises(MaskError, match="quality_policy_failed"):
        quality.apply_policy(quality.report(s, quality.snapshot(a.withColumn("x", F.lit(0.0)))), {"mode": "fail", "min_marginal": 0.99})


def test_generation(spark):
    from sparkmask.functions.kernel import Kernel

    parent = spark.range(5).withColumnRenamed("id", "pid")
    cols = {"id": {"type": "sequence", "prefix": "A", "pad": 4, "start": -2}, "p": {"type": "reference", "table": "p", "column": "pid", "mode": "random", "min_per_parent": 3}, "f": {"type": "faker", "provider": "synthetic_npi"}, "x": {"type": "categorical", "categories": ["a", "b"], "null_probability": 0.5}, "y": {"type": "formula", "formula": "x + '!'"}}
    df = generate.generate_table(spark, "t", 60, cols, Kernel(1), {"p": parent})
    rows = df.orderBy("id").collect()
    assert {r.id for r in rows} >= {"A-002", "A0000", "A0057"} and 10 < sum(r.x is None for r in rows) < 50
    assert min(r["count"] for r in df.groupBy("p").count().collect()) >= 3
    again = generate.generate_table(spark, "t", 60, cols, Kernel(1), {"p": parent}).repartition(5).orderBy("id").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_vault_and_unmask(spark, people):
    cols = [{"name": "email", "strategy": "hash", "namespace": "e", "vault": True}, {"name": "tag", "strategy": "fpe", "namespace": "f", "provider_config": {"charset": "alpha"}}]
    r = run_pipeline(spark, config(cols, row_key=["id"]), {"t": people})
    key = b"0" * 16
    opened = vault.opened(vault.sealed(r.vault, key), key)
    ctx = {c.name: context(r.plan, "t", c, people) for c in r.plan.config.tables["t"].columns}
    back, status = vault.unmask(r.tables["t"], ctx, {"email": "hash", "tag": "fpe"}, opened)
    assert status == {"email": "vault", "tag": "inverted"}
    assert values(back, "email") == values(people, "email") and values(back, "tag") == values(people, "tag")


def test_scans(spark, people):
    cols = [{"name": "name", "strategy": "hash", "namespace": "a"}, {"name": "email", "strategy": "redact"}]
    r = run_pipeline(spark, config(cols, row_key=["id"]) | {"global_settings": {"post_validation": {"primary_keys": {"t": ["id"]}}}}, {"t": people})
    assert r.quality["status"] == "pass", r.quality
    bad = audit.run_scans({"t": people}, {"t": people}, {"tables": {"t": {"columns": cols}}, "row_keys": {"t": ["id"]}})
    assert bad["status"] == "fail" and any(c["scan"] == "leakage" and c["status"] == "fail" for c in bad["checks"])


def test_walks():
    c = walks.Column
    schema = {"users": (c("id", pk=True), c("boss_id")), "posts": (c("id", pk=True), c("user_id"), c("item_type"), c("item_id")), "a": (c("id", pk=True), c("b_id")), "b": (c("id", pk=True), c("a_id"))}
    links = [walks.Link("users", "boss_id", "users", "id"), walks.Link("posts", "user_id", "users", "id"), walks.Link("posts", "item_id2", "users", "id")]
    kinds = {(h.kind, h.table) for h in walks.hazards(schema, links)}
    assert kinds >= {("SR", "users"), ("PE", "posts"), ("PM", "posts"), ("CIR", "a")}
    assert walks.drift({"a": (c("x"),)}, {"a": (c("x", "int"), c("y")), "b": ()}) == [("a", "x", "type"), ("a", "y", "added"), ("b", "", "added")]


def test_csv_and_ipc(spark, tmp_path):
    import pyarrow as pa

    from sparkmask.sources.files import load_value_lists, read_source, write_target

    (tmp_path / "a.csv").write_text("zip,n\n00123,1\n")
    assert read_source(spark, {"format": "csv", "path": str(tmp_path / "a.csv")}).first().zip == "00123"
    batch = pa.table({"x": [1, 2, 3]})
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, batch.schema) as w:
        w.write_table(batch)
    df = read_source(spark, {"format": "ipc", "path": str(tmp_path / "a.arrow")})
    assert sorted(r.x for r in df.collect()) == [1, 2, 3]
    write_target(df, {"format": "csv", "path": str(tmp_path / "out")})
    assert read_source(spark, {"format": "csv", "path": str(tmp_path / "out")}).count() == 3
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "team.txt").write_text("red\nblue\n")
    assert load_value_lists(str(tmp_path / "lists")) == ["custom.team"]


def test_connector(spark, tmp_path):
    from sparkmask.sources import connectors

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\n")
    connectors.register(spark)
    df = spark.read.format("sparkmask_lines").option("path", str(tmp_path / "in")).load()
    assert sorted(r.line for r in df.collect()) == ["x", "y"]
    df.write.format("sparkmask_lines").mode("append").option("path", str(tmp_path / "out")).save()
    assert any(p.name == "_SUCCESS" for p in (tmp_path / "out").iterdir())
    with pytest.raises(connectors.PermanentError):
        connectors.LocalFolder(str(tmp_path)).open("../../etc/passwd")


def test_stream_equals_batch(spark, tmp_path):
    from sparkmask.streaming.masks import mask_stream

    df = spark.range(30).selectExpr("id", "concat('u', id) as name")
    df.write.parquet(str(tmp_path / "in"))
    plan = compile_plan(config([{"name": "name", "strategy": "hash", "namespace": "n"}]))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = mask_stream(plan, "t", stream).writeStream.format("memory").queryName("masked_out").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = run_pipeline(spark, config([{"name": "name", "strategy": "hash", "namespace": "n"}]), {"t": df}).tables["t"]
    assert sorted(map(tuple, spark.table("masked_out").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("rows", [40, 100_000])
def test_nearest_of_all_rows(spark, rows):
    r = random.Random(5)
    row = lambda i: (i, None if r.random() < 0.05 else round(r.uniform(-50, 900), 2), r.choice(["a", "b", "c", None]), r.choice("xy"))
    src, out = [row(i) for i in range(120)], [row(i) for i in range(5200)]
    span = max(x[1] for x in src if x[1] is not None) - min(x[1] for x in src if x[1] is not None)
    far = lambda a, b: ((1.0 if a[1] is None or b[1] is None else min(abs(a[1] - b[1]) / span, 1.0)) + (a[2] != b[2]) + (a[3] != b[3])) / 3
    kind = "id long, v double, c string, d string"
    a, b = spark.createDataFrame(src, kind), spark.createDataFrame(out, kind)
    df = quality.nearest(a, b, ["v"], ["c", "d"], cap=None, key="id") if rows > 40 else quality.nearest_of_all(a, b, ["v"], ["c", "d"], "id", rows)
    got = {x.id: x.distance for x in df.collect()}
    assert len(got) == 5200 and all(got[o[0]] == pytest.approx(min(far(o, s) for s in src)) for o in out)


def test_quantiles_are_exact_without_all_values_in_one_task(spark, monkeypatch):
    rng = random.Random(4)
    cases = {
        "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(900)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308],
        "near": [1e5 + i * 2**-36 for i in range(700)] + [1e300, -3.0], "copies": [7.25] * 500 + [7.5] * 500 + [0.1], "integers": [float(i % 97) for i in range(1000)],
        "pair": [1.0, 2.0], "one": [-4.5], "none": [],
    }
    for cells in (2, 4096):
        monkeypatch.setattr(profile, "RANGE_CELLS", cells)
        for name, xs in cases.items():
            if cells == 2 and name in ("mixed", "near"):  # as many passes as bits
                continue
            rng.shuffle(xs)
            df = spark.createDataFrame([(v,) for v in [*xs, None, float("nan"), float("inf")]], "x double").repartition(5)
            row = profile.numeric_stats(df, "x").first()
            order = sorted(xs)
            for p in profile.QUANTILES:
                got = row[f"p{int(100 * p):02d}"]
                if not xs:
                    assert got is None and row["n"] == 0
                    continue
                a = p * (len(xs) - 1)
                lo, hi = int(a), -int(-a // 1)
                assert got == (order[lo] if order[lo] == order[hi] else (hi - a) * order[lo] + (a - lo) * order[hi]), (name, p)


def test_quantiles_have_no_aggregate_of_all_values(spark):
    plan = profile.numeric_stats(spark.range(100).selectExpr("cast(id as double) as x"), "x")._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_texts_are_redacted_in_slices():
    """A worker makes objects of one slice of a batch of texts at a time."""
    import pyarrow as pa

    done = []
    batches = iter([pa.array([str(i) for i in range(detectors.SLICE * 3 + 1)]), pa.array([], pa.string()), pa.array([None, "x"])])
    out = detectors.in_slices(batches, lambda x: done.append(x) or x)
    assert len(next(out)) == len(done) == detectors.SLICE
    assert [len(x) for x in out] == [detectors.SLICE, detectors.SLICE, 1, 2] and done[-2:] == [None, "x"]


def test_texts_are_redacted_beside_other_python_functions(spark):
    """Batches that are no multiple of a slice, nulls, two columns of texts and a column of another Python function in one select."""
    n = detectors.SLICE * 2 + 7
    text = lambda i: None if i % 11 == 0 else f"{i} mail a{i}@x.org or 078-05-112{i % 10}"
    df = spark.createDataFrame([(i, text(i), text(i + 1), f"{i:05d}") for i in range(n)], "id int, a string, b string, c string").coalesce(1)
    mask = {"strategy": "text_redact", "provider_config": {"label_token": True}}
    out = run_pipeline(spark, config([{"name": "a", **mask}, {"name": "b", **mask}, {"name": "c", "strategy": "fpe", "namespace": "f"}]), {"t": df}).tables["t"].orderBy("id").collect()
    want = lambda i: None if i % 11 == 0 else f"{i} mail [EMAIL] or [SSN]"
    assert [(r.a, r.b) for r in out] == [(want(i), want(i + 1)) for i in range(n)]
    assert len({r.c for r in out}) == n and all(len(r.c) == 5 for r in out)
