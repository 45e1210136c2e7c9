"""The pipeline on the smallest tables, and what its stages keep."""

import corpus_pipeline
from aforo.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= 2 * before
    result = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert result.count() == docs.count()


def test_run_gives_a_row_per_document_of_the_mix(spark):
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [r.start for r in rows[:2]] == [0, rows[0].n_tokens] and len(rows) > 100
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids)


def test_empty_documents_give_no_rows(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if set(docs.columns) >= {"text"} else docs
    assert docs.count() == 0


def test_documents_without_labels_pass_the_language_stage(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 34 !", None), (None, "other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, SF).collect()
    assert sorted(r.text for r in got) == ["other words", "some words"]
