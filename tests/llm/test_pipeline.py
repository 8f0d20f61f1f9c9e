import corpus_pipeline
from matchrank.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "personal_data", "packing"]
    before = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = before, {r.doc_id for r in before.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == before.columns and now <= seen, name
        seen = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == seen


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
