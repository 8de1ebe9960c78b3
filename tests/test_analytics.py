import numpy as np
import pytest

from cloudsieve.plans import analytics as A
from cloudsieve.plans import selection as S


def test_selection_cascade_takes_the_simplest_near_best(spark):
    rng = np.random.default_rng(0)
    y = np.tile([0, 1], 40)
    base = rng.normal(size=80)
    strength = {"glob_cs": 0.2, "glob_full": 0.4, "loc10": 3.0, "loc05": 3.0}
    rows = []
    for k in (10, 20):
        for rule in S.RULES:
            for pool in S.POOLING:
                s = base + y * strength.get(rule, 0.5) * (1 if k == 20 else 0.3) * (1.5 if pool == "max" else 1)
                for pre in ("", "h1_"):
                    rows += [(k, "d", "u", str(i), int(y[i]), f"{pre}{rule}_{pool}", float(s[i])) for i in range(80)]
    rec = spark.createDataFrame(rows, "k int, dataset string, unit string, file string, label int, key string, score double")
    full = S.alias_missing_views(rec)
    assert full.where("key = 'loc10_V01_p99'").count() == 160
    units = S.unit_values(full)
    got = S.select_configuration(units)
    assert (got.max_nn, got.rule, got.views, got.mhr) == (20, "loc10", "V0", False)
    assert got.pooling in ("p99", "max")
    ci = S.differences_to_best(units, ["loc10_p99", "glob_cs_p99"], 20, 50).toPandas()
    assert ci.option.tolist() == ["glob_cs_p99"] and ci.hi[0] < 0


def test_merge_rejects_duplicates_and_missing(spark):
    cats = spark.createDataFrame([("a", 0), ("b", 1)], "category string, ord int")
    p = spark.createDataFrame([("a", 1.0), ("__mean__", 1.0)], "category string, v double")
    r = spark.createDataFrame([("b", 3.0)], "category string, v double")
    got = A.merge_parts([p, r], cats, ["v"]).toPandas().sort_values("ord")
    assert got.category.tolist() == ["a", "b", "__mean__"] and got.v.tolist() == [1.0, 3.0, 2.0]
    with pytest.raises(ValueError, match="duplicate"):
        A.merge_parts([p, p], cats, ["v"])
    with pytest.raises(ValueError, match="missing"):
        A.merge_parts([p], cats, ["v"])
    assert A.merge_parts([p], cats, ["v"], True).count() == 2


def test_fusion_rejects_different_samples(spark):
    rows = [("c", "f0", 0, "a", 0.1), ("c", "f1", 1, "a", 0.9), ("c", "f0", 0, "b", 0.3), ("c", "f1", 1, "b", 0.2)]
    s = spark.createDataFrame(rows, "category string, file string, label int, run string, score double")
    got = A.subset_fusion(s, ["a", "b"]).where("category = 'c'").toPandas().set_index("combo").auroc
    assert got.to_dict() == {"a": 1.0, "b": 0.0, "a+b": 1.0}
    with pytest.raises(Exception, match="sample sets"):
        A.subset_fusion(s.where("NOT (file = 'f1' AND run = 'b')"), ["a", "b"]).count()


def test_significance_and_round_robin(spark):
    d = spark.createDataFrame([(1.0, 2.0), (-2.0, -1.0), (-1.0, 1.0)], "lo double, hi double")
    assert tuple(A.significance_counts(d).first()) == (1, 1, 1)
    j = spark.createDataFrame([(i,) for i in range(5)], "job int")
    assert [r.worker for r in A.round_robin(j, "job", 2).orderBy("job").collect()] == [0, 1, 0, 1, 0]


def test_small_strata_draw_by_hash():
    import hashlib

    import numpy as np

    from cloudsieve.plans import bootstrap as B

    def mix(h):
        h ^= h >> 16
        h = h * B.MIX[0] % 2**32
        h ^= h >> 13
        h = h * B.MIX[1] % 2**32
        return h ^ h >> 16
    want = np.zeros((7, 3), int)
    for b in (3, 4, 5):
        h = mix((int(hashlib.md5(b"0|c|1").hexdigest()[:8], 16) + b * B.STEPS["b"]) % 2**32)
        for i in range(7):
            want[int(mix((h + i * B.STEPS["draw"]) % 2**32) / 4294967296.0 * 7), b - 3] += 1
    assert (B.draw_weights("c|1", 7, 3, 5, 0) == want).all()


def test_parts_of_a_large_stratum_make_up_its_draws():
    """Every replicate draws n times in all; weights look multinomial, within and between parts and replicates."""
    import numpy as np

    from cloudsieve.plans import bootstrap as B
    n, reps = 1003, 400
    assert B.parts_of(n, 40) == 32 and B.parts_of(40, 40) == 1 and B.parts_of(41, 40) == 2
    w = np.concatenate([B.draw_weights("c|0", n, 1, reps, 5, p, 40) for p in range(32)]).astype(int)
    assert w.shape == (n, reps) and (w.sum(0) == n).all()
    assert abs(w.var() - (1 - 1 / n)) < 0.02 and np.abs(w.mean(1) - 1).max() < 0.3
    half = w[:500].sum(0)  # binomial(n, 500 / n)
    assert abs(half.var() / (n * 500 / n * (1 - 500 / n)) - 1) < 0.25
    share = np.bincount(w.ravel(), minlength=4)[:4] / w.size
    assert np.abs(share - np.exp(-1) / np.array([1, 1, 2, 6])).max() < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
    again = B.draw_weights("c|0", n, 1, reps, 5, 17, 40)
    assert (again == w[B._edge(n, 32, 17):B._edge(n, 32, 18)]).all()


def test_large_strata_in_spark(spark):
    import numpy as np

    from cloudsieve.plans import bootstrap as B
    strata = spark.createDataFrame([("a", 95), ("b", 10), ("c", 11)], "k string, n long")
    rows = B.weight_blocks(strata, ["k"], 30, block=12, part_members=10).toPandas()
    for k, n in (("a", 95), ("b", 10), ("c", 11)):
        for first in (1, 13, 25):
            mine = rows[(rows.k == k) & (rows._first == first)].sort_values("idx")
            assert mine.idx.tolist() == list(range(n))
            w = np.array([list(v) for v in mine.w])
            assert (w.sum(0) == n).all()


def test_unit_bootstrap_matches_its_weights(spark):
    import numpy as np

    from cloudsieve.plans import bootstrap as B
    rng = np.random.default_rng(1)
    rows = [(o, d, u, float(rng.normal())) for o in ("p", "q") for d in ("x", "y") for u in range(9)]
    got = {r["option"]: r for r in B.unit_bootstrap(spark.createDataFrame(rows, "option string, dataset string, unit int, diff double"), 60).collect()}
    index = {r["unit"]: r["idx"] for r in B.hash_index(spark.createDataFrame([("p", u) for u in range(9)], "option string, unit int"), ["option"], "unit").collect()}
    for o in ("p", "q"):
        means = []
        for d in ("x", "y"):
            w = B.draw_weights(d, 9, 1, 60, 0).astype(float)
            v = np.zeros(9)
            for oo, dd, u, x in rows:
                if (oo, dd) == (o, d):
                    v[index[u]] = x
            means.append(v @ w / w.sum(0) * 100)
        m = np.mean(means, axis=0)
        assert np.allclose([got[o]["lo"], got[o]["hi"]], np.percentile(m, [2.5, 97.5]))


def test_bootstrap_blocks(spark, monkeypatch):
    import numpy as np

    from cloudsieve.plans import bootstrap as B
    rng = np.random.default_rng(0)
    rows = [(s, ch, c, f"{c}{i}", int(i % 3 == 0), float(np.round(rng.normal(), 1))) for s in (0, 1) for ch in ("a", "b")
            for c in ("x", "y") for i in range(40)]
    scores = spark.createDataFrame(rows, "seed int, channel string, category string, file string, label int, score double")
    key = ["b", "seed", "channel", "category"]
    whole = B.bootstrap_auroc(scores, 6).toPandas().sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(B, "RANGE_ROWS", 10)
    monkeypatch.setattr(B, "_ROWS", 8)
    cut = B.bootstrap_auroc(scores, 6).toPandas().sort_values(key).reset_index(drop=True)
    assert len(whole) == 48 and np.allclose(whole.auroc, cut.auroc, equal_nan=True)
    with pytest.raises(ValueError, match="series"):
        B.bootstrap_auroc(scores.where("NOT (seed = 1 AND channel = 'b' AND file = 'x3')"), 2)


def test_alignment_diagnostic(spark):
    import numpy as np

    from cloudsieve.plans.diagnostics import alignment_diagnostic
    rng = np.random.default_rng(2)

    def sphere(n, shift=0.0):
        x = rng.normal(size=(n, 3))
        x *= np.array([1.0, 0.6, 0.4]) / np.linalg.norm(x, axis=1, keepdims=True)
        return x + shift
    protos = [("c", o, i, *map(float, p)) for o in (0, 1) for i, p in enumerate(sphere(600))]
    clouds = [("c", n, i, *map(float, p)) for n, s in (("near", 0.0), ("off", 0.02)) for i, p in enumerate(sphere(400, s))]
    surface = spark.createDataFrame(protos, "category string, obj int, point_idx long, x double, y double, z double")
    asked = spark.createDataFrame(clouds, "category string, cloud_id string, point_idx long, x double, y double, z double")
    got = alignment_diagnostic(asked, surface).toPandas().set_index("cloud_id")
    merged = np.array([p[3:] for p in protos])
    for name in ("near", "off"):
        mine = np.array([p[3:] for p in clouds if p[1] == name])
        d = np.sqrt(((mine[:, None] - merged[None]) ** 2).sum(2))
        assert np.allclose(got.loc[name, ["res_med", "res_p90", "res_p99"]].astype(float), np.percentile(d.min(1), [50, 90, 99]))
        assert np.isclose(got.loc[name, "rev_p90"], np.percentile(d.min(0), 90))
    a, b = merged[:600], merged[600:]
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert np.isclose(got.loo_med.iloc[0], (np.median(d.min(1)) + np.median(d.min(0))) / 2)
    assert got.loc["off", "ref_trans"] > got.loc["near", "ref_trans"] and got.loc["off", "ref_res_med"] < got.loc["off", "res_med"]


def test_bootstrap_weights_are_never_broadcast(spark):
    from cloudsieve.plans import bootstrap as B
    rng = np.random.default_rng(2)
    rows = [(s, ch, "c", i % 2, i, float(rng.normal())) for s in (0, 1) for ch in ("a", "b") for i in range(40)]
    scores = spark.createDataFrame(rows, "seed int, channel string, category string, label int, file int, score double")
    values = spark.createDataFrame([(o, "x", u, 1.0) for o in ("p", "q") for u in range(9)], "option string, dataset string, unit int, diff double")
    for out in (B.bootstrap_auroc(scores, 300), B.unit_bootstrap(values, 60)):
        assert out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        at = next(i for i, line in enumerate(plan) if "MapInArrow" in line and "_first" in line and " w#" in line)
        above = [line for i, line in enumerate(plan[:at]) if len(line) - len(line.lstrip(" :+-")) < len(plan[at]) - len(plan[at].lstrip(" :+-"))]
        assert not any("BroadcastExchange" in line for line in above)


def test_packed_weights_are_the_same_weights(spark):
    from cloudsieve.plans import bootstrap as B
    strata = spark.createDataFrame([("x", 41), ("y", 3)], "k string, n int")
    plain, packed = (B.weight_blocks(strata, ["k"], 30, block=12, packed=p).orderBy("k", "_first", "idx").toPandas() for p in (False, True))
    assert [bytes(w) for w in plain.w] == [B._unpacked([bytes(w)]).tobytes() for w in packed.w]
