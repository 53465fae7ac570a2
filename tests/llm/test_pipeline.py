"""The registered queries and the pipeline."""

import compare
import corpus_pipeline
import pytest

from strataplane.llm import lines, minhash, queries
from strataplane.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    assert compare.differences(spark, compare.connect(SF), SF, queries.QUERIES[name], queries.ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    if name == "op12_whitening":
        assert rows == 4 * table(spark, SF, "embeddings").count()
    elif name == "op11_mixture_packing":
        assert rows >= table(spark, SF, "documents").count()
    elif name not in ("op5_license_scan", "op6_best_fit_packing"):
        assert rows == table(spark, SF, "pages" if "html" in name or "url" in name else "documents").count()


def test_stages(spark):
    scratch, docs = Scratch(spark, "stages"), table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, SF))
        assert docs.columns == columns, name
        left = docs.count()
        assert 0 < left <= n and (left == n or name in ("quality_rules", "near_duplicates"))
        if name == "near_duplicates":
            kept = {r.doc_id for r in minhash.near_duplicates(before, 5, 80).where("kept").collect()}
            assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            want = {r.doc_id: r.text for r in lines.drop_boilerplate(before).collect()}
            assert want == {r.doc_id: r.text for r in docs.collect()}
        n = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n
    assert pieces.count() == corpus_pipeline.run(spark, SF).count()
