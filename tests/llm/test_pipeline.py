"""The corpus pipeline against its stages' own brute force on the smallest tables."""

import corpus_pipeline
from axialis.llm import decontaminate, near_dedup, queries, toxicity
from axialis.llm.common import documents


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    clean = corpus_pipeline.toxicity(spark, docs, sf_dir).persist()
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, queries._labels(spark, sf_dir)).collect()}
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}
    single = corpus_pipeline.near_dedup(spark, clean, sf_dir).persist()
    classes = near_dedup.near_duplicates(clean).groupBy("class_id").agg({"doc_id": "min"}).collect()
    assert {r[0] for r in single.select("doc_id").collect()} == {r[1] for r in classes}
    held = decontaminate.contamination(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct().collect()
    left = corpus_pipeline.decontamination(spark, single, sf_dir).persist()
    assert left.count() == single.count() - len(held)
    mixed = corpus_pipeline.mixing(spark, left, sf_dir)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) == mixed.count() and min(r["start"] for r in out) == 0
    assert max(r["start"] + r["n_tokens"] for r in out) == sum(r["n_tokens"] for r in out)


def test_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, target long"
    rows = {"empty": [], "blank": [(k, None, "en", "s", 0, 1) for k in range(5)]}
    for name, own in rows.items():
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        assert corpus_pipeline.run(spark, sf).count() == 0  # a source without words isn't taken


def test_tokens_in_training_order(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    mixed = corpus_pipeline.mixing(spark, docs, sf_dir)
    mixed.write.parquet(f"{tmp_path}/mixed")
    due = [r["doc_id"] for r in mixed.collect()]
    got = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf_dir)
    assert [r["doc_id"] for r in sorted(got.collect(), key=lambda r: r["start"])] == due
    plain = corpus_pipeline.tokens(spark, docs, sf_dir).orderBy("start").collect()
    assert len(plain) == docs.count()
