import os

import compare
import duckdb
import pytest

import corpus_pipeline
from ledgerline.llm import bpe, decontamination, near_dedup, queries, stages

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, FOLDER), compare.connect(FOLDER), queries.ORACLES[name]) == []


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in stages.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{FOLDER}/labels.parquet' WHERE toxic = 1").fetchall()}
    for name, stage in stages.STAGES:
        before = docs
        docs = stage(spark, before, FOLDER).cache()
        if name != "bpe":
            assert docs.columns == before.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        gone = {r["doc_id"] for r in before.select("doc_id").collect()} - ids
        if name == "toxicity":
            assert not ids & toxic
        if name == "line_dedup":
            assert not gone
        if name == "near_dedup":
            assert ids == {r["doc_id"] for r in near_dedup.near_duplicates(before).where("kept").collect()}
        if name == "decontamination":
            assert gone == {r["doc_id"] for r in decontamination.mark_leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("leaked").collect()}
        if name == "bpe":
            assert not gone and docs.where("NOT intact OR size(ids) != n_tokens").count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "ids", "n_tokens", "intact"] and 0 < rows.count() <= 200
    path = f"{queries.public_tokenizers.path(queries.TOKENIZER)}"
    assert bpe.decode(rows, path).count() == rows.count()
