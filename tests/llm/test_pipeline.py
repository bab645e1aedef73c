import corpus_pipeline
import pytest

import __spark_entry__ as contract
from check import compare, duck
from zonalpanel.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_match_their_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.CHECKS[name]) == ""


def test_ten_queries_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= names


def test_stages_one_by_one(spark, documents, corpus):
    """Each stage returns the columns of documents and what its operator keeps."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    docs = documents(corpus + [(500 + i, f"you idiot {i} scum and trash " * 3) for i in range(3)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, SF)
        assert result.columns == docs.columns, name
        assert result.count() <= docs.count(), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= docs and len({r.doc_id for r in rows}) > 0.7 * len(docs)


def test_empty_documents(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
