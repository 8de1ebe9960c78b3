import numpy as np
import pandas as pd
import pytest

from cloudsieve.operators.neighbours import neighbours, smallest_k


def clouds(seed, n, copies=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(n // 2, 3)), rng.normal(scale=0.02, size=(n - n // 2 - copies, 3)),
                   np.repeat([[0.5, 0.5, 0.5]], copies, axis=0)])
    pdf = pd.DataFrame(x, columns=["x", "y", "z"])
    pdf["g"] = np.where(np.arange(len(pdf)) % 4 == 0, "a", "b")
    pdf["point_idx"] = np.arange(len(pdf))
    pdf["obj"] = rng.integers(0, 3, len(pdf))
    return pdf


def brute(q, r, k, exclude=None, radius=None):
    out = set()
    for g in q.g.unique():
        a, b = q[q.g == g], r[r.g == g].sort_values("point_idx")
        d = np.sqrt(((a[["x", "y", "z"]].values[:, None] - b[["x", "y", "z"]].values[None]) ** 2).sum(-1))
        if exclude:
            d[a[exclude].values[:, None] == b[exclude].values[None]] = np.inf
        if radius is not None:
            d[d > radius] = np.inf
        for i, pid in enumerate(a.point_idx.values):
            o = np.argsort(d[i], kind="stable")
            o = o[np.isfinite(d[i][o])][:k]
            out |= {(g, pid, b.point_idx.values[j], round(float(d[i][j]), 9)) for j in o}
    return out


def as_set(df):
    return {(r.g, r.qid, r.rid, round(r.dist, 9)) for r in df.collect()}


@pytest.mark.parametrize("tile,exclude", [(64, None), (64, "obj"), (64, "point_idx"), (4096, "point_idx")])
def test_knn_matches_brute_force(spark, tile, exclude):
    r, q = clouds(1, 420, copies=140), clouds(2, 160, copies=30)
    got = neighbours(spark.createDataFrame(q), spark.createDataFrame(r), 5, ["g"],
                     exclude=(exclude, exclude) if exclude else None, tile_rows=tile)
    assert as_set(got) == brute(q, r, 5, exclude)


@pytest.mark.parametrize("tile", [64])
def test_radius_join_matches_brute_force(spark, tile):
    r, q = clouds(3, 500, copies=50), clouds(4, 200)
    got = neighbours(spark.createDataFrame(q), spark.createDataFrame(r), None, ["g"], radius=0.3, tile_rows=tile)
    assert as_set(got) == brute(q, r, None, None, 0.3)


def test_vector_metric_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16))
    pdf = pd.DataFrame({"point_idx": np.arange(400), "v": list(v), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})
    df = spark.createDataFrame(pdf)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for tile in (100,):
        got = neighbours(df, df, 3, [], vec=("v", "v"), exclude=("point_idx", "point_idx"), tile_rows=tile).toPandas()
        want = {(i, j) for i in range(400) for j in np.argsort(d[i])[:3]}
        assert set(zip(got.qid, got.rid)) == want


def test_larger_k_keeps_smaller_result(spark):
    r, q = clouds(6, 400), clouds(7, 100)
    run = lambda k: as_set(neighbours(spark.createDataFrame(q), spark.createDataFrame(r), k, ["g"], tile_rows=64))
    assert run(3) <= run(6)


def test_smallest_k_breaks_ties_by_index():
    d = np.array([[1.0, 0.0, 1.0, 1.0, 0.0]])
    assert smallest_k(d, 3).tolist() == [[1, 4, 0]]
    assert smallest_k(d, 9).tolist() == [[1, 4, 0, 2, 3]]


def test_radius_summary_matches_pairs(spark):
    r, q = clouds(8, 400, copies=60), clouds(9, 120)
    from cloudsieve.operators.neighbours import radius_summary
    got = radius_summary(spark.createDataFrame(q), spark.createDataFrame(r), 0.3, ["g"], "point_idx", "point_idx",
                         tile_rows=64).toPandas().set_index("qid")
    pairs = pd.DataFrame(list(brute(q, r, None, None, 0.3)), columns=["g", "qid", "rid", "d"]).groupby("qid").d
    assert (got.n.sort_index() == pairs.size().sort_index()).all()
    assert np.allclose(got.reach.sort_index(), pairs.max().sort_index())


def test_small_groups_share_a_call(spark):
    rng = np.random.default_rng(5)
    rows = [(None if g == 7 else f"g{g}", i, *map(float, rng.uniform(size=3))) for g in range(60) for i in range(1 + g % 5)]
    df = spark.createDataFrame(rows, "g string, point_idx int, x double, y double, z double")
    near = neighbours(df, df, 2, ["g"])
    assert "_lot" in near._jdf.queryExecution().analyzed().toString()
    got = {(r["g"], r["qid"], r["rank"]): (r["rid"], r["dist"]) for r in near.collect()}
    want = {}
    for g, i, *p in rows:
        d = sorted((float(np.linalg.norm(np.subtract(p, o))), j) for h, j, *o in rows if h == g)
        want |= {(g, i, k + 1): (j, v) for k, (v, j) in enumerate(d[:2])}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def test_tiles_are_asked_by_tables_and_not_by_repeated_plans(spark):
    df = spark.createDataFrame(clouds(3, 600))
    near = neighbours(df, df, None, ["g"], radius=0.3, tile_rows=40)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and plan.count("Join ") < 30
