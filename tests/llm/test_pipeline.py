import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmask.llm import near_duplicates, packing, quality, toxicity

from .test_llm import near_group, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    texts = [prose(50, i) for i in range(150)] + near_group(prose(90, 7), 12, 3, 8) + [prose(50, 3), "too short", None, " ".join(["same eight words in every window of it"] * 9)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = []
    for i in range(0, 140):
        toxic = i % 5 == 0
        if toxic:
            w = rows[i][1].split()
            for k, t in enumerate(random.Random(i).sample(["grumblefig", "snarkwit", "dolthead"], 2)):
                w[3 + 7 * k] = t
            rows[i] = (i, " ".join(w), *rows[i][2:])
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, labels


def test_stages_against_brute_force(spark, tables):
    d, rows, labels = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_dedup", "packing"]
    clean = corpus_pipeline.clean(spark, docs, d)
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    assert ids == {r[0] for r in rows} - {i for i, _, t in labels if t}
    sound = corpus_pipeline.sound(spark, clean, d)
    want = {r.doc_id for r in quality.judged(clean).collect() if r.kept}
    assert {r.doc_id for r in sound.collect()} == want and sound.columns == docs.columns and ids - want == {163, 164, 165}
    single = corpus_pipeline.single(spark, sound, d)
    brute = near_duplicates.brute_force([(r.doc_id, r.text) for r in sound.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in brute.items() if i == c)
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in brute.items() if i == c}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_repeated_rows_and_extra_columns(spark, tables):
    d, rows, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit("x")).withColumn("_key", F.lit(1))
    twice = docs.unionByName(docs.where("doc_id in (2, 141, 164)"))
    single = corpus_pipeline.single(spark, twice, d)
    assert single.columns == docs.columns and single.where("doc_id = 2").count() == 1 and single.where("doc_id = 164").count() == 1
    model = toxicity.Model(None, [])
    assert toxicity.with_scores(twice, model, "toxicity_score").count() == len(rows) + 3
    assert corpus_pipeline.clean(spark, docs.limit(0), d).count() == 0 and corpus_pipeline.sound(spark, docs.limit(0).drop("_key"), d).count() == 0
    assert packing.pack(docs.limit(0)).count() == 0
