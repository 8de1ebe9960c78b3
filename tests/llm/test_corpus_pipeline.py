import corpus_pipeline
from conftest_llm import AWKWARD

from cloudsieve.llm import exact_dedup, language_mixture, mixing, simhash


def test_stages_in_order(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash", "mixing", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, small)
    model = language_mixture.fit(docs.where(~language_mixture.held_out()))
    want = {r.doc_id for r in docs.collect() if language_mixture.infer(r.text, model)[0] != "und" and language_mixture.infer(r.text, model)[1] >= 0.5}
    assert ids(known) == want and known.columns == docs.columns
    single = stages["exact_dedup"](spark, known, small)
    assert ids(single) == {r.doc_id for r in exact_dedup.exact_dedup(known).where("kept").collect()}
    near = stages["simhash"](spark, single, small)
    found = simhash.near_duplicates(single).collect()
    assert ids(near) == {r.component_id for r in found} and near.count() == len({r.component_id for r in found})
    mixed = stages["mixing"](spark, near, small)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix_sources(near).agg({"copies": "sum"}).first()[0]
    packed = stages["packing"](spark, mixed, small)
    assert packed.where("start = 0").count() == mixed.count()
    whole = corpus_pipeline.run(spark, small)
    assert whole.columns == packed.columns
    total = lambda df: df.agg({"length": "sum"}).first()[0]
    assert whole.count() == packed.count() and total(whole) == total(packed)


def test_awkward_rows_pass_every_stage(spark, frame, small):
    for rows in (AWKWARD, []):
        docs = frame(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
            else:
                assert out.count() >= docs.count()
