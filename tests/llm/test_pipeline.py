import corpus_pipeline
from lodestone.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_should(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, before = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == documents.columns and docs.schema["n_chars"].dataType == documents.schema["n_chars"].dataType
        n = docs.count()
        assert n == before if name == "repeats" else before * 0.5 < n <= before
        before = n
    assert docs.where("n_chars <> char_length(text)").count() == 0
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("start = 0").count() == before


def test_an_empty_corpus_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_all_ten_are_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names >= {f"op{i}" for i in range(1, 11)}
