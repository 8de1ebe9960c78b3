import numpy as np
import pandas as pd

from cloudsieve.operators import cleanup as C
from shapes import sphere


def brute_clusters(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(axis=1) >= least
    lab = np.full(len(x), -1)
    for i in np.nonzero(core)[0]:
        if lab[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if lab[j] >= 0:
                continue
            lab[j] = i
            todo += list(np.nonzero(d[j] & core & (lab < 0))[0])
    for i in np.nonzero(~core)[0]:
        near = lab[d[i] & core]
        lab[i] = near.min() if len(near) else -1
    return lab


def test_density_clusters_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(scale=0.05, size=(150, 3)), rng.normal(scale=0.05, size=(120, 3)) + [1, 0, 0],
                   np.column_stack([np.linspace(0, 1, 40), np.full(40, 1.0), np.zeros(40)]), rng.uniform(-1, 2, size=(20, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y", "z"]).assign(c="a", point_idx=np.arange(len(x))))
    extent = np.linalg.norm(np.ptp(x, axis=0))
    got = C.density_clusters(df, ["c"], 0.03).toPandas().set_index("point_idx").cluster
    want = brute_clusters(x, 0.03 * extent, 5)
    assert {i: c for i, c in enumerate(want) if c >= 0} == got.to_dict()


def test_scan_loses_table_and_stray_points(spark):
    rng = np.random.default_rng(1)
    obj = sphere(rng, 1500) * 0.2 + [0.5, 0.5, 0.45]
    g = np.linspace(0, 1, 40)
    table = np.array([[a, b, 0.0005 * rng.normal()] for a in g for b in g])
    border = np.array([a < 0.1 or a > 0.9 or b < 0.1 or b > 0.9 for a in g for b in g])
    stray = np.array([[0.05, 0.05, 0.9], [0.06, 0.05, 0.9], [0.05, 0.06, 0.9], [0.055, 0.05, 0.9], [0.05, 0.055, 0.9]])
    x = np.vstack([obj, table, stray])
    pdf = pd.DataFrame(x, columns=["x", "y", "z"]).assign(c="a", point_idx=np.arange(len(x)))
    pdf["border"] = np.concatenate([np.zeros(1500, bool), border, np.zeros(5, bool)])
    got = C.clean_scan(spark.createDataFrame(pdf), ["c"]).toPandas().point_idx
    assert set(got) == set(range(1500))


def consensus(x, head):
    """Trial by trial, in one place."""
    from hashlib import md5
    x = x[np.lexsort(x.T)]
    limit = C.PLANE_SHARE * np.linalg.norm(np.ptp(x, axis=0))
    best, most = None, -1
    for t in range(C.PLANE_TRIALS):
        p = x[[int(int(md5(f"{head}|{t}|{j}".encode()).hexdigest()[:8], 16) / 4294967296.0 * len(x)) for j in range(3)]]
        n = np.cross(p[1] - p[0], p[2] - p[0])
        if np.linalg.norm(n) > 0:
            near = np.abs((x - p[0]) @ (n / np.linalg.norm(n))) <= limit
            if near.sum() > most:
                best, most = near, near.sum()
    inner = x[best]
    axis = np.linalg.svd(inner - inner.mean(0), full_matrices=False)[2][2]
    return axis, -axis @ inner.mean(0)


def test_planes_from_blocks_match_the_sequential_consensus(spark):
    rng = np.random.default_rng(4)
    frames, clouds = [], {}
    for name, n in (("a", 400), ("b", 130), ("c", 60)):
        x = np.column_stack([rng.uniform(size=(n, 2)), 0.2 + 0.0004 * rng.normal(size=n)])
        x[:n // 4] = rng.uniform(size=(n // 4, 3))
        clouds[name] = x
        frames.append(pd.DataFrame(x, columns=["x", "y", "z"]).assign(k=name))
    df = spark.createDataFrame(pd.concat(frames))
    got = {r["k"]: r for r in C.fit_planes(df, C.extents(df, ["k"]), ["k"], block_rows=50, limit=100).collect()}
    assert set(got) == {"a", "b"}  # c has too few points
    for k, r in got.items():
        axis, w = consensus(clouds[k], f"0|{k}")
        sign = np.sign(axis @ [r["pa"], r["pb"], r["pc"]])
        assert np.allclose(sign * axis, [r["pa"], r["pb"], r["pc"]], atol=1e-9) and np.isclose(sign * w, r["pw"])


def test_numbers_across_ranges_are_those_of_one_window(spark):
    from cloudsieve.operators.prefix import ordered_index
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 500, p=[0.8, 0.1, 0.1]), "p": [f"f{v:05d}" for v in rng.permutation(500)], "v": 1})
    df = spark.createDataFrame(pdf, "g string, p string, v int")
    for keys in (["g"], []):
        many, one = (ordered_index(df, keys, ["p"], "i", first=1, limit=m) for m in (30, 10**6))
        assert sorted(map(tuple, many.select("p", "i").collect())) == sorted(map(tuple, one.select("p", "i").collect()))
        assert many.columns == ["g", "p", "v", "i"]


def test_small_clouds_share_the_calls_of_a_summary(spark):
    from cloudsieve.operators.neighbours import neighbours
    rows = [(g, i, float(i), 0.0, 0.0, 1 + i) for g in range(40) for i in range(1 + g % 4)]
    df = spark.createDataFrame(rows, "c int, point_idx int, x double, y double, z double, _w int")
    near = neighbours(df, df, None, ["c"], radius=1.5, payload=["_w"], custom=C._weight_around(1.5))
    assert "_lot" in near._jdf.queryExecution().analyzed().toString()
    got = {(r["c"], r["qid"]): r["_n"] for r in near.collect()}
    assert got == {(g, i): sum(1 + j for j in range(1 + g % 4) if abs(i - j) <= 1) for g, i, *_ in rows}


def test_small_clouds_are_clustered_in_one_call_as_by_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    frames = []
    for k, n in (("a", 180), ("b", 60), ("c", 1), ("d", 4)):
        x = np.vstack([rng.normal(scale=0.05, size=(n, 3)), rng.uniform(-1, 1, size=(n // 3, 3))])
        x[: n // 4] = x[0]
        frames.append(pd.DataFrame(x, columns=["x", "y", "z"]).assign(c=k, point_idx=rng.permutation(len(x)) + 7))
    df = spark.createDataFrame(pd.concat(frames))
    rows = lambda d: sorted(map(tuple, d.select("c", "point_idx", "cluster").collect()))
    cells = rows(C.density_clusters(df, ["c"], 0.06, limit=0))
    assert len(cells) > 60
    assert rows(C.density_clusters(df, ["c"], 0.06, limit=100)) == cells
    monkeypatch.setattr(C, "neighbours", None)  # small clouds need no joins
    assert rows(C.density_clusters(df, ["c"], 0.06)) == cells


def test_small_clouds_find_their_planes_in_one_call_as_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frames = []
    for i in range(12):
        x = np.column_stack([rng.uniform(size=(130, 2)), 0.2 + 0.0004 * rng.normal(size=130)])
        x[:30 + i] = rng.integers(0, 4, size=(30 + i, 3)) / 4  # repeated places
        frames.append(pd.DataFrame(x, columns=["x", "y", "z"]).assign(k=f"c{i}", g=i % 2))
    frames.append(pd.DataFrame({"x": np.ones(120), "y": 1.0, "z": 2.0}).assign(k="one place", g=0))
    df = spark.createDataFrame(pd.concat(frames)).selectExpr("nullif(k, 'c3') AS k", "g", "x", "y", "if(x > 0.97, NULL, z) AS z")
    extent = C.extents(df, ["k", "g"])
    names = ["pa", "pb", "pc", "pw"]
    blocks = {(r["k"], r["g"]): [r[n] for n in names] for r in C.fit_planes(df, extent, ["k", "g"], block_rows=50).collect()}
    monkeypatch.setattr(C, "ordered_index", None)  # neither points nor trials of small clouds are numbered and joined
    got = {(r["k"], r["g"]): [r[n] for n in names] for r in C.fit_planes(df, extent, ["k", "g"]).collect()}
    assert set(got) == set(blocks) == {(f"c{i}", i % 2) for i in range(12) if i != 3}
    for k, want in blocks.items():
        assert np.allclose(got[k], want, atol=1e-9) or np.allclose(got[k], [-v for v in want], atol=1e-9)
