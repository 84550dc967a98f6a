import corpus_pipeline
import pytest
from quorumlab.llm.registry import QUERIES


def test_stages_follow_each_other(spark, sf_dir, documents, tmp_path):
    docs = documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        following = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert following.columns == documents.columns and following.count() <= docs.count()
            docs = following
    assert {r["doc_id"] for r in following.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, stage):
    stage(spark, odd_docs, sf_dir).collect()
    assert stage(spark, no_docs, sf_dir).count() == 0


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
