"""The pipeline: stages in their order, whole results, and the last stage over what is left."""

import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tailorbird.llm import queries


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_dedup", "substring_dedup", "decontamination", "best_fit_packing",
    ]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_run(spark, tmp_path):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    passage, secret, texts = text(60), text(30), [text(r.randint(30, 120)) for _ in range(40)]
    texts[3], texts[4] = texts[3] + " " + passage, passage + " " + texts[4]
    texts += [texts[0], texts[1] + " " + secret, "1234 !!", None, passage]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {x["doc_id"] for x in out.select("doc_id").distinct().collect()}
    assert kept == set(range(40)), kept  # 44 is all of a passage that 3 and 4 have; 40 is a copy, 41 leaks, 42 and 43 have no language
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_empty(spark, tmp_path):
    spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame(
        [(1, "some text", None, "s", 9), (2, "été", None, "s", 3), (3, "12 !²", None, "s", 5), (4, None, None, "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 2]
