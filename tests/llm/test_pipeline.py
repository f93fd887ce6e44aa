"""Each pipeline stage against a plain version on its own input."""

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_packing
from tidemark.llm import secret_scan, toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name == "toxicity":
            weights = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            expected = {i for i, r in before.items() if toxicity.text_score(r.text, weights) < 0.5}
        elif name == "near_duplicates":
            groups = brute([(i, r.text) for i, r in before.items()], 5, 80)
            expected = {i for i, (_, c) in groups.items() if i == c}
        else:
            expected = set(before)
        if name == "packing":
            check_packing(after.collect(), {i: r.text for i, r in before.items()})
            return
        assert after.columns == docs.columns and sorted(r.doc_id for r in after.collect()) == sorted(expected)
        for r in after.collect():
            assert r.text == (secret_scan.redacted(before[r.doc_id].text, "[SECRET]") if name == "secrets" else before[r.doc_id].text)
        docs = after


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", "x"), (2, "", "x"), (3, "same text of a few words here", "x"), (4, "same text of a few words here", "x")], "doc_id long, text string, text2 string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 2, 3] and out.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        assert stage(spark, docs, sf).count() >= 4
