import corpus_pipeline as C
from factloom.llm import decontam, langid, quality, setjoin


def test_stages_chain_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= before, name
    kept = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in C.run(spark, small).collect()} == kept
    labels, benchmark = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontam.find_items(docs, benchmark).count() == 0
    assert all(r.component_id == r.doc_id for r in setjoin.components_of(docs).collect())
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(kept & bad) < 0.5 * len(bad)  # 11 rows and a model of 200 documents; test_quality has the sharper bound
    assert len(kept) > 0.5 * spark.read.parquet(f"{small}/documents.parquet").count()
    assert langid.UND and quality.HELD_OUT


def test_odd_documents_pass_through_every_stage(spark, odd, empty, small):
    for table in (odd, empty):
        for _, stage in C.STAGES:
            stage(spark, table, small).collect()
