import corpus_pipeline
from tests.llm.helpers import clashing, empty, odd

SF = "/root/testdata/sf0.001"


def test_stages_by_parquet_and_whole_runs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if i < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_stages_take_odd_rows(spark):
    docs = clashing(odd(spark))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name


def test_the_last_stage_takes_odd_rows(spark):
    docs = clashing(odd(spark))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids", "text"]
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in out.collect() if r.doc_id) == sorted((r.doc_id is None, r.doc_id, r.text or "") for r in docs.collect() if r.doc_id)
    assert out.count() == docs.count()


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name
