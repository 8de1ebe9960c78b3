import numpy as np
from conftest_llm import AWKWARD
from pyspark.sql import functions as F

from cloudsieve.llm import language_mixture as L

TRAIN = [(i, "the house and the other thing with that " * 3, "en") for i in range(5)] + \
    [(i, "das haus und die andere sache mit der schule " * 3, "de") for i in range(5)]


def test_mixture_and_undetermined(frame):
    model = L.fit(frame(TRAIN))
    assert model.languages == ("de", "en")
    assert L.infer("the thing with the house", model)[:2] == ("en", 1.0)
    mixed = L.infer("the house and the other thing with that " * 8 + "das haus und die andere sache mit der schule " * 5, model)
    assert mixed[0] == "en" and [x for x, _ in mixed[2]] == ["en", "de"] and 0.5 < mixed[1] < 0.75
    assert abs(sum(s for _, s in mixed[2]) - 1) < 1e-6
    for text in (None, "", "12 34 !?", "_"):
        assert L.infer(text, model) == ("und", 0.0, [])


def test_em_raises_likelihood():
    rng = np.random.default_rng(1)
    like, n = rng.random((3, 40)) + 0.01, rng.integers(1, 9, 40)
    shares, best = L._mixture(like, n, np.ones(3) / 3)
    assert abs(shares.sum() - 1) < 1e-9 and best >= float(n @ np.log(np.ones(3) / 3 @ like))


def test_awkward_rows(frame):
    docs = frame(AWKWARD + [(20, "the house", None)])
    model = L.fit(frame(TRAIN))
    got = L.identify(docs, model)
    assert got.columns.count("score") == 1 and "kept" in got.columns and got.count() == len(AWKWARD) + 1
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 7, 12, None}
    assert got.where("score < 0 OR score > 1").count() == 0


def test_nothing_learned(frame):
    model = L.fit(frame([(1, None), (2, "x y", None)]))
    assert model.languages == () and L.infer("hello there", model) == ("und", 0.0, [])
    assert L.identify(frame([]), model).count() == 0


def test_held_out_accuracy_and_no_leak(spark, small):
    from cloudsieve.llm.queries import QUERIES
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = QUERIES["op9_language_mixture"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and len(held) and (held.lang_pred == held.lang).mean() > 0.97
    # other labels, sources and ids of held-out rows change nothing
    model = L.fit(docs.where(~L.held_out()))
    blank = docs.where(L.held_out()).select("doc_id", "text", F.lit("zz").alias("lang"))
    again = L.identify(blank, model).select("doc_id", "lang_pred", "score").toPandas().set_index("doc_id").sort_index()
    assert (again.lang_pred == held.set_index("doc_id").sort_index().lang_pred).all()
