import math

import numpy as np
import pytest

from cloudsieve.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string, dims string"


def plain(rows, every, positives=5, negatives=3):
    whole = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v], c) for n, (i, v, c) in enumerate(rows)
             if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [r for r in whole if sum(x * x for x in r[2]) < 2 ** 61]
    out = []
    for n, i, a, c in whole:
        if i is None or i % every:
            continue
        found = sorted(((-sum(x * y for x, y in zip(a, b)), j is None, j or 0, j, d) for m, j, b, d in whole if m != n and len(a) == len(b)),
                       key=lambda t: t[:3])
        for p in [f for f in found if f[4] == c][:positives]:
            hard = [f for f in found if f[4] != c and 50 * -p[0] <= 100 * -f[0] <= 95 * -p[0]][:negatives]
            out += [(i, p[3], r + 1, f[3], -p[0], -f[0]) for r, f in enumerate(hard)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", "y", "z") for i, v, c in rows], SCHEMA)


def mined(spark, rows, every):
    return sorted([tuple(r) for r in H.mine(table(spark, rows), every).collect()], key=str)


@pytest.mark.parametrize("block,anchors", [(16_384, 16_384), (16, 7)])
def test_matches_brute_force(spark, monkeypatch, block, anchors):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 18))
    rows = [(i, (centres[i % 4] + 0.7 * rng.normal(size=18)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(160)]
    rows += [(200 + i, rows[5][1], i % 2) for i in range(20)]  # ties in both labels
    rows += [(300, None, 1), (301, [1.0] * 17 + [None], 1), (302, [float("nan")] * 18, 1), (305, rows[3][1], None),
             (310, [1.0, 2.0], 0), (315, [2.0, 1.0], 0), (320, [1.0, 1.0], 1), (None, rows[9][1], 2), (10, rows[8][1], 1), (10, rows[8][1], 1),
             (325, [], 0), (330, [], 0), (335, [], 1), (340, [0.0] * 18, 0), (345, [1e9] * 18, 0), (350, [1e30] * 18, 0), (355, [-1e6] * 18, 1)]
    got = mined(spark, rows, 5)
    assert got == plain(rows, 5) and len(got) > 100


def test_one_label_few_rows_and_empty_table(spark):
    assert H.mine(table(spark, [])).count() == 0
    assert mined(spark, [(i, [1.0, float(i)], 1) for i in range(0, 100, 10)], 50) == []  # no other label
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 2)], 50) == []  # no positive
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.5, 0.0], 2), (53, [0.96, 0.0], 2), (54, [-1.0, 0.0], 1)]
    assert mined(spark, rows, 50) == plain(rows, 50) == [(50, 51, 1, 52, 65536, 32768)]


def test_windows_hold_their_ends_and_nothing_for_negative_scores():
    for score in (*range(-300, 300), 2**60 + 7):
        a, b = H.window_of(score)
        if abs(score) < 300:
            assert [s for s in range(-300, 300) if 50 * score <= 100 * s <= 95 * score] == list(range(a, b + 1))
        assert (a <= b) == (score == 0 or score > 1) or score < 0


@pytest.mark.parametrize("same", [True, False])
def test_scan_shrinks_but_keeps_every_answer(same):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-60, 60, size=(500, 24))
    vectors[:, 0] *= 30
    labels = rng.integers(0, 3, 500).tolist()
    block = H.Block(np.arange(500), labels, vectors, np.arange(500))
    for n in range(20):
        exact = vectors @ vectors[n]
        best = sorted(exact[[i for i in range(500) if i != n and labels[i] == labels[n]]])[-5:]
        windows = () if same else tuple(H.window_of(int(p)) for p in best)
        places, scores = H.scan(H.Anchor(n, labels[n], vectors[n], None, windows), block, same, 3)
        rows = block.rows[places]
        assert (exact[rows] == scores).all() and len(rows) < 100
        for a, b in windows or [(best[0], best[-1])]:
            wanted = sorted((exact[i] for i in range(500) if i != n and (labels[i] == labels[n]) == same and a <= exact[i] <= b), reverse=True)[:3]
            assert sorted((s for s in scores if a <= s <= b), reverse=True)[:3] == wanted
