"""The pipeline's stages on planted cases, and its bookkeeping."""

from pyspark.sql import functions as F

import corpus_pipeline
from lineament.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    words = lambda k, n=120: " ".join(f"w{k}x{j}" for j in range(n))
    item = " ".join(f"b{j}" for j in range(12))
    near = words(3).replace("w3x50", "other")
    rows = [(k, words(k) + "\n" + "Site line here", "en", "s0", 1) for k in range(30)] + [(40, words(3), "en", "s1", 1), (41, near, "en", "s1", 1), (42, words(42) + " " + item, "en", "s1", 1), (43, item, "en", "s1", 1), (44, "too short", "en", "s1", 1), (45, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {*range(30), 40, 41, 42}
    lines = stages["line dedup"](spark, kept, str(tmp_path))
    assert lines.columns == COLUMNS and {r.doc_id: r.text for r in lines.collect()}[5] == words(5)
    single = stages["n-gram Jaccard join"](spark, lines, str(tmp_path))
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == {*range(30), 42}
    clean = stages["benchmark decontamination"](spark, single, str(tmp_path))
    assert clean.columns == COLUMNS and {r.doc_id: r.text for r in clean.collect()}[42] == words(42) + " "
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {*range(30), 42}


def test_odd_tables(spark, tmp_path):
    """Empty tables, clashing columns and repeated ids pass all stages."""
    words = lambda k, n=120: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(1, words(1), "en", "s", 7, "a"), (1, words(2), "en", "s", 7, "b"), (2, words(1), None, None, None, "c"), (None, words(3), "en", "s", 7, "d"), (5, None, "en", "s", 0, "e"), (6, "", "en", "s", 0, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __host string").withColumn("__kept", F.lit(0)).withColumn("__spans", F.col("__host")).withColumn("__words", F.lit(1))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table, want in ((docs, {"a", "b", "d"}), (docs.limit(0), set())):
        at = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns
        out = at.collect()
        assert {r["__host"] for r in out} == want and all(r.n_chars == len(r.text) and r["__spans"] == r["__host"] for r in out)
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()} == {r.doc_id for r in out}


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
