import math

import numpy as np
import pytest

from cloudsieve.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string"


def plain(rows, every, k):
    whole = [(i, j, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (j, v) in enumerate(rows)
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, a in whole:
        if q is None or q % every:
            continue
        found = sorted(((-sum(x * y for x, y in zip(a, b)), c is None, c or 0, c) for n, c, b in whole if n != i and len(b) == len(a)), key=lambda t: t[:3])
        out += [(q, r + 1, c, -s) for r, (s, _, _, c) in enumerate(found[:k])]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [(4096, 1024), (16, 3)])
def test_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(T, "CANDIDATES", sizes[0])
    monkeypatch.setattr(T, "QUERIES", sizes[1])
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(300, None), (301, [1.0] * 19 + [None]), (302, [float("nan")] * 20), (303, [float("inf")] + [0.0] * 19), (305, [1.0, 2.0]),
             (None, rows[5][1]), (400, []), (401, []), (10, rows[7][1]), (10, rows[7][1]), (410, [0.0] * 20)]
    got = sorted([tuple(r) for r in T.top_k(vectors(spark, rows), every=5, k=5).collect()], key=str)
    assert got == plain(rows, 5, 5)


def test_large_components_stay_exact():
    q = np.array([[3 * 10**8 + 1], [-5 * 10**8]], np.int64)
    v = np.array([[10**9, 10**9 - 1, 7], [1, -3, 10**9]], np.int64)
    (at, scores), = T.best_of_block(q, np.array([99]), v, np.arange(3), np.arange(3), 2)
    want = sorted(((-(int(q[0, 0]) * int(v[0, j]) + int(q[1, 0]) * int(v[1, j])), j) for j in range(3)))[:2]
    assert [(-int(s), int(a)) for a, s in zip(at, scores)] == want


def test_few_rows_and_empty_table(spark):
    assert T.top_k(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in T.top_k(vectors(spark, [(50, [1.0]), (51, [2.0])])).collect()] == [(50, 1, 51, 256 * 512)]
    assert T.top_k(vectors(spark, [(50, [1.0])])).count() == 0
