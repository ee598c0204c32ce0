"""Stages of the corpus pipeline: each on its own input, and the whole run."""

import corpus_pipeline
from leafline.llm import tokens


def test_stages_keep_the_columns(spark, odd, tables):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, tables)
        assert out.columns == odd.columns, name
        out.collect()


def test_stages_on_an_empty_table(spark, none, tables):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).collect() == []


def test_decisions(spark, odd, tables):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["SimHash near-dedup"](spark, odd, tables).collect()
    assert sum(r.doc_id in (1, 2) for r in kept) == 1 and {r.doc_id for r in kept} >= {None, 1, 6, 7, 8}
    clean = stages["benchmark decontamination"](spark, odd, tables).collect()
    assert not {r.doc_id for r in clean} & {1, 2} and {r.doc_id for r in clean} >= {None, 3, 4, 5, 6, 7, 8}
    named = stages["language ID"](spark, odd, tables).collect()
    assert not {r.doc_id for r in named} & {3, 4, 5} and {1, 2, 7, 8} <= {r.doc_id for r in named}


def test_run(spark, prose, tables, tmp_path):
    prose.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and set(rows[0].asDict()) == {f.name for f in tokens.ARROW}
    ids = {d for r in rows for d in r.doc_ids}
    assert ids and ids <= {r.doc_id for r in prose.collect()}
