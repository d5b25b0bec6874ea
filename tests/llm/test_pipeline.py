"""The stages one by one, and the pipeline over the small data."""

import re

import corpus_pipeline
from tests.llm.test_duplicates import brute_near, norm


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456", None, "src1", 7), (9002, None, None, None, None), (9003, "Same  text here now ok", "en", "src1", 1), (9004, "Same text here now ok", "en", "src1", 1)], docs.schema)
    d = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    a = stages["language"](spark, d, None).persist()
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in d.collect()} - {9001, 9002} and a.columns == d.columns
    b = stages["exact_dedup"](spark, a, None).persist()
    first = {}
    for r in a.collect():
        first[norm(r.text)] = min(first.get(norm(r.text), r.doc_id), r.doc_id)
    assert {r.doc_id for r in b.collect()} == set(first.values()) and b.columns == d.columns
    c = stages["near_dedup"](spark, b, None).persist()
    rows = [(r.doc_id, r.text) for r in b.collect()]
    assert {r.doc_id for r in c.collect()} == {i for (i, _), (_, k) in zip(rows, brute_near(rows, 80), strict=True) if i == k}
    m = stages["mixing"](spark, c, None).persist()
    assert m.columns == d.columns and 0.9 < sum(len(re.findall(r"\S+", r.text)) for r in m.collect()) / sum(len(r.text.split()) for r in c.collect()) < 1.1
    e = stages["sentencepiece"](spark, m, None)
    assert e.columns == [*d.columns, "piece_ids"] and e.count() == m.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_near_stage_drops_pairs_from_0_80_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = []
    for i in range(40):  # 100 shingles, of which a changed word at the end, or two, take away 5 to 12: similarities 0.77 to 0.91
        words = [f"w{i}x{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: 104 - (5 + i % 8)], *(f"v{i}x{k}" for k in range(5 + i % 8))]))]
    made = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], docs.schema)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, made, None).collect()}
    assert got == {i for (i, _), (_, k) in zip(rows, brute_near(rows, 80), strict=True) if i == k}
    assert got != {i for (i, _), (_, k) in zip(rows, brute_near(rows, 85), strict=True) if i == k}
