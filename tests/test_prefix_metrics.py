import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudsieve.functions import metrics as M
from cloudsieve.functions import pooling
from cloudsieve.operators import prefix
from cloudsieve.operators.prefix import (average_ranks, hash_index, hash_sample, lower_quantile_of, ordered_totals,
                                         percentile_of, range_cuts, with_range)


def skewed(n=4000, seed=0):
    """One group with a third of all rows, one value with a third of that group's rows."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 12, n).astype(str))
    s = rng.normal(size=n).round(2)
    s[(g == "hot") & (rng.random(n) < 0.34)] = 0.5
    return pd.DataFrame({"g": g, "s": s, "y": rng.integers(0, 2, n), "id": np.arange(n)})


def pair_auroc(y, s):
    a, b = s[y == 1].to_numpy(), s[y == 0].to_numpy()
    return ((a[:, None] > b[None]).mean() + 0.5 * (a[:, None] == b[None]).mean())


@pytest.mark.parametrize("limit", [100, 10**6])
def test_statistics_do_not_depend_on_ranges(spark, limit):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    t = ordered_totals(df, ["g"], "s", limit=limit)
    got = t.groupBy("g").agg(percentile_of(0.99).alias("p99"), percentile_of(0.5).alias("mid"),
                             lower_quantile_of(0.5).alias("low"), pooling.rule_column("top10").alias("top10"),
                             pooling.rule_column("mean").alias("mean")).toPandas().set_index("g")
    auc = M.roc_table(df, ["g"], "y", "s", limit=limit).groupBy("g").agg(
        M.auroc_agg().alias("a"), M.average_precision_agg().alias("ap")).toPandas().set_index("g")
    rank = average_ranks(df, ["g"], "s", limit=limit).toPandas().set_index("id").avg_rank
    for g, p in pdf.groupby("g"):
        v = np.sort(p.s.to_numpy())
        r = got.loc[g]
        assert np.isclose(r.p99, np.percentile(v, 99)) and np.isclose(r.mid, np.median(v))
        assert r.low == v[(len(v) - 1) // 2] and np.isclose(r.top10, v[-10:].mean()) and np.isclose(r["mean"], v.mean())
        assert np.isclose(auc.a[g], pair_auroc(p.y, p.s))
        assert np.allclose(rank[p.id].to_numpy(), p.s.rank().to_numpy())


def test_auroc_is_invariant_under_monotone_maps_and_null_for_one_class(spark):
    df = spark.createDataFrame(skewed(800))
    a = M.detection_metrics(df, ["g"], "y", "s").toPandas().set_index("g")
    b = M.detection_metrics(df.withColumn("s", F.exp("s")), ["g"], "y", "s").toPandas().set_index("g")
    assert np.allclose(a.sort_index(), b.sort_index())
    one = M.detection_metrics(df.where("y = 1"), ["g"], "y", "s").toPandas()
    assert one.auroc.isna().all() and one.aupr.isna().all()


@pytest.mark.parametrize("limit", [100, 10**6])
def test_hash_sample_and_index(spark, limit):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = hash_sample(df, ["g"], 200, F.lit("x"), F.col("id"), limit=limit).toPandas()
    sizes = pdf.groupby("g").size().clip(upper=200)
    assert (got.groupby("g").size() == sizes).all() and got.id.is_unique
    idx = hash_index(df, ["g"], "id", limit=limit).toPandas()
    for _, p in idx.groupby("g"):
        assert sorted(p.idx) == list(range(len(p))) and (p.n == len(p)).all()


def test_unknown_rule_raises_and_custom_rules_work(spark):
    with pytest.raises(ValueError):
        pooling.rule_column("best")
    pooling.register_rule("spread", lambda: F.max("v") - F.min("v"))
    got = pooling.object_scores(spark.createDataFrame(skewed(300)), ["g"], "s", ["spread", "max"]).toPandas()
    assert (got.spread >= 0).all()


def test_ranges_are_cut_again_until_none_is_large(spark):
    rng = np.random.default_rng(4)
    # a frequent greatest value, a frequent inner one, and a dense place beside wide tails
    v = np.concatenate([np.full(900, 9.0), np.full(700, 0.25), rng.random(1200), rng.normal(scale=1e-6, size=900), rng.normal(scale=99, size=300).clip(-500, 9)])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(v)) % 5 == 0, "a", "b"), "s": v, "id": np.arange(len(v))})
    df = spark.createDataFrame(pdf).cache()
    cuts = range_cuts(df, ["g"], "s", 20, 4)
    assert len(cuts) > 2
    cells = with_range(df, cuts, ["g"], "s", 4).groupBy("g", "_range").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).toPandas().sort_values(["g", "_range"])
    assert (cells.n[cells.low < cells.high] <= 20).all() and len(cells) > 60
    for _, one in cells.groupby("g"):
        assert (one.high.to_numpy()[:-1] < one.low.to_numpy()[1:]).all()
    assert range_cuts(df, ["g"], "s", 10**6) is None
    rank = average_ranks(df, ["g"], "s", limit=20, heavy_shares=16).toPandas()
    assert sorted(rank.columns) == ["avg_rank", "g", "id", "s"] and len(rank) == len(pdf)
    expected = pdf.set_index("id").groupby("g").s.rank()
    assert np.allclose(rank.set_index("id").avg_rank.sort_index(), expected.sort_index())


def test_ranges_are_cut_from_distinct_values(spark):
    rows = [("g", float(i % 5)) for i in range(600)] + [("h", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    t = ordered_totals(df, ["k"], "v", limit=100)
    assert "_range" not in t._jdf.queryExecution().analyzed().toString()
    got = {r["v"]: (r["cnt"], r["cnt_before"], r["cnt_total"]) for r in t.where("k = 'g'").collect()}
    assert got == {float(i): (120.0, (4 - i) * 120.0, 600.0) for i in range(5)}


def test_ranges_grow_with_the_value(spark):
    cuts = [float(c) for c in range(0, 254, 2)]
    df = spark.createDataFrame([("g", i / 2) for i in range(-4, 520)] + [("h", 1.0)], "k string, v double")
    side = spark.createDataFrame([("g", cuts)], "k string, _cuts array<double>")
    got = {(r["k"], r["v"]): r["_r0"] for r in prefix._next_range(df, side, ["k"], "v", 0).collect()}
    assert all(got["g", v] == 2 * sum(c < v for c in cuts) + (v in cuts) for v in [i / 2 for i in range(-4, 520)]) and got["h", 1.0] == 0
