"""The pipeline on planted cases, and its registration."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from vertexflow.llm import queries


def test_pipeline(spark, small, tmp_path):
    base = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40)
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first()["text"]
    columns = base.columns
    planted = base.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 9000)
    extra = spark.createDataFrame([(9100, f"before it {item} after it", "en", "s", 1), (9101, "12 34 !!", "en", "s", 1), (9102, None, None, None, None)], base.schema)
    base.unionByName(planted).unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert not kept & {9000, 9001, 9002, 9003, 9004, 9100, 9101, 9102} and len(kept) >= 25
    assert columns == base.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near-dedup", "decontamination", "packing"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_pipeline_judges_rows_of_null_and_repeated_ids_by_their_texts(spark, small, tmp_path):
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first()["text"]
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))

    def stages(docs, name):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
        return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)

    base = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40)
    clean = stages(base, "a")
    t, rest = [x for _, x in clean if len(x) > 300][:6], base.schema
    stay = [(k, x) for k, x in clean if x not in t] + [(None, t[0]), (None, t[1]), (7000, t[2]), (7000, t[3]), (8000, t[4])]
    go = [(None, f"{t[5]} {item}"), (7000, t[2]), (None, t[4]), (7000, f"{t[5]} then {item}")]
    planted = spark.createDataFrame([(k, x, "en", "s", len(x)) for k, x in stay + go], rest)
    assert stages(planted, "b") == sorted(stay, key=str)


def test_stages_pass_odd_columns_and_empty_tables(spark, small):
    rows = [(1, "the same text here with enough words for all of it", {"a": 1}), (1, "the same text here with enough words for all of it", {"b": 2}), (2, "quite another text that nobody else has written before", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>").withColumns({c: F.lit("x") for c in ("lang", "source", "id", "key", "words", "hit", "row", "item", "n", "bucket", "line", "place")}).withColumn("n_chars", F.length("text").cast("long"))
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.near_dup_stage, corpus_pipeline.benchmark_stage):
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} <= {1, 2}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dup_stage(spark, docs, small).collect()) == [1, 2]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []
