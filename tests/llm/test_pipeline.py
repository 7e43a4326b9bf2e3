"""The pipeline's stages and queries on the smallest tables."""

import re

import duckdb

import corpus_pipeline
from furrow.llm import queries
from furrow.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        rows = out.collect()
        assert out.columns == docs.columns, name
        if name != "mix_sources":
            assert len({r.doc_id for r in rows}) == len(rows)
        if name == "near_duplicates":
            assert len({r.text for r in rows}) == len(rows)
        assert all(r.text == before[r.doc_id].text or "[SECRET]" in r.text for r in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert last.count() == len(rows)
    assert not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text) for r in rows)


def test_lm_score_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(c.execute(queries.oracle_sql()["op1_lm_score"]).fetchall())
    assert sorted(map(tuple, queries.op1_lm_score(spark, SF).collect())) == expected
