import corpus_pipeline
import pytest

from folioflux.llm import queries
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def test_stages_filter_in_order_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "packing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF).persist()
        assert after.columns == docs.columns and after.count() <= left.count()
        assert after.join(left, "doc_id", "left_anti").count() == 0
        left = after
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in left.select("doc_id").collect()}


def test_planted_rows_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = "Completely clean words about rivers, mountains, meadows and slow boats on a quiet morning in late autumn."
    planted = [(90001, clean, "en", "s", 1), (90002, clean + " Indeed.", "en", "s", 1), (90003, f"Before. {item} After.", "en", "s", 1), (90004, None, None, None, None), (90005, "", "en", "s", 0)]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    for _, stage in corpus_pipeline.STAGES[1:3]:
        rows = stage(spark, rows, SF).persist()
    assert {r[0] for r in rows.select("doc_id").collect()} & set(range(90001, 90010)) == {90001, 90004, 90005}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0
