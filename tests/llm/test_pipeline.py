"""Each stage on its predecessor's result."""

import corpus_pipeline
from quarry.llm import bpe, neardup, suffix, toxicity
from quarry.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark, small):
    docs, seen = small, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        seen.append((name, docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == small.columns
        docs = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    model = toxicity.fit_toxic(a, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(a, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert {r.doc_id for r in b.collect()} == clean
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in neardup.classes(b).where("kept").collect()}
    cut = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffix.deduplicate(c).collect()}
    assert {r.doc_id: r.text for r in d.collect()} == cut
    assert all(r.n_chars == len(r.text) for r in d.collect())
    assert e.count() >= d.count() and e.select("doc_id").distinct().count() == d.count()
    assert sorted((r.doc_id, r.n_tokens) for r in f.collect()) == sorted((r.doc_id, len(r.ids)) for r in bpe.encode(e).collect())


def test_run(spark):
    import os

    from quarry.llm.common import shared_dir

    listed = lambda: set(os.listdir(f"{shared_dir(spark).removeprefix('file://')}/quarry"))
    before = listed()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [x.split("-")[0] for x in listed() - before] == [corpus_pipeline.STAGES[-2][0]]


def test_odd_tables_through_all_stages(spark, odd, none):
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, docs, SF), name)
            assert name == corpus_pipeline.STAGES[-1][0] or (out.columns == table.columns and out.schema["bucket"].dataType == table.schema["bucket"].dataType)
            docs = out
        ids = {r.doc_id for r in docs.collect()}
        assert ids == ({r.doc_id for r in odd.collect()} - {2} if table is odd else set())
