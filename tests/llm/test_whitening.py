import numpy as np
import pytest

from cloudsieve.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component string, x string, n string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", "x", "n", "d") for i, v in rows], SCHEMA)


def reference(vectors):
    """Axes and eigenvalues from the centred rows by a plain decomposition."""
    x = np.floor(64 * np.asarray(vectors, float))
    c = x - x.mean(0)
    _, s, w = np.linalg.svd(c, full_matrices=False)
    return c, s ** 2 / len(c), w.T


def check(rows, got, components=32):
    ids = [i for i, _ in rows]
    c, e, w = reference([v for _, v in rows])
    z = {(r["vec_id"], r["component"]): r for r in got}
    k = min(components, c.shape[1])
    assert len(z) == len(got) == len(rows) * k
    for j in range(k):
        mine = np.array([z[i, j + 1]["whitened"] for i in ids])
        want = c @ w[:, j] / np.sqrt(e[j])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-6
        assert abs(z[ids[0], j + 1]["explained"] / (e[j] / e.sum()) - 1) < 1e-9
    x = [[int(np.floor(64 * v)) + 1_000_000 for v in row] for _, row in rows]
    sums = [sum(col) for col in zip(*x)]
    for i, row in zip(ids, x):
        assert int(z[i, 1]["deviation"]) == sum((len(rows) * a - s) ** 2 for a, s in zip(row, sums))
        assert z[i, 1]["n"] == len(rows) and z[i, 1]["identity_error"] < 1e-9


def test_matches_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(40, 40)) * np.geomspace(1, 20, 40)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 40)) @ mix)]
    bad = [(900, None), (901, [None] + [0.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [1e300] * 40)]
    check(rows, W.whiten(table(spark, rows + bad)).collect())
    got = W.whiten(table(spark, rows), components=3).collect()
    check(rows, got, 3)


def test_ill_conditioned_rows_keep_small_components(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 4)) * [1e6, 1e3, 3, 0.5]
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    rows = table(spark, list(enumerate(v @ turn))).selectExpr("transform(embedding, c -> bigint(floor(c * 64))) AS x")
    model = W.fit(rows)
    _, want, _ = reference(v @ turn)
    assert np.abs(model.eigenvalues / want - 1).max() < 1e-6 and model.rank == 4
    assert W.identity_error(rows, model) < 1e-5


def test_constant_and_dependent_entries_have_no_whitened_value(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [a, 2 * a, 5.0, b]) for i, (a, b) in enumerate(rng.integers(-9, 9, size=(50, 2)))]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) == 200
    assert {r["component"] for r in got if r["whitened"] is None} == {3, 4}
    assert all(abs(r["explained"]) < 1e-12 for r in got if r["component"] > 2) and got[0]["identity_error"] < 1e-9
    same = W.whiten(table(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)


def test_lengths_repeats_and_empty_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 2, rng.normal(size=3)) for i in range(20)] + [(None, rng.normal(size=3))]
    got = W.whiten(table(spark, rows + [(50, [1.0]), (51, []), (50, [1.0])])).collect()
    odd = [r for r in got if r["component"] is None]
    assert sorted(r["vec_id"] for r in odd) == [50, 50, 51] and all(r["n"] is None and r["whitened"] is None for r in odd)
    assert len(got) == 21 * 3 + 3 and {r["n"] for r in got if r["component"]} == {21}
    assert W.whiten(table(spark, [])).count() == 0
    assert [r["component"] for r in W.whiten(table(spark, [(1, []), (2, None)])).collect()] == [None]


@pytest.mark.parametrize("size", [1 << 45, 1 << 52])
def test_large_entries_stay_exact(spark, size):
    rows = [(0, [size / 64.0, 1.0]), (1, [0.0, 2.0]), (2, [-size / 64.0, 4.0])]
    got = {r["vec_id"]: int(r["deviation"]) for r in W.whiten(table(spark, rows)).collect() if r["component"] == 1}
    x = [[size, 64], [0, 128], [-size, 256]]
    assert got == {i: sum((3 * a - s) ** 2 for a, s in zip(r, (0, 448))) for i, r in enumerate(x)}


def test_solves_undo_triangular_factors():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(7, 5))
    r, t = (np.triu(rng.normal(size=(5, 5)) + 3 * np.eye(5)) for _ in range(2))
    assert np.allclose(W.solved(a @ r @ t, [t, r]), a)
