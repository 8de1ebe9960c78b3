import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cloudsieve.operators import synth as S
from cloudsieve.operators import tolerance as T
from shapes import sphere


def table(spark, x, **cols):
    return spark.createDataFrame(pd.DataFrame(x, columns=["x", "y", "z"]).assign(point_idx=np.arange(len(x)), **cols))


def test_defect_moves_points_along_normals_and_labels_them(spark):
    x = sphere(np.random.default_rng(0), 3000, noise=0.0)
    df = table(spark, x, cloud_id="a")
    out, info = S.inject_defect(df, ["cloud_id"], 4)
    got = out.toPandas().sort_values("point_idx")
    i = info.toPandas().iloc[0]
    moved = np.linalg.norm(got[["x", "y", "z"]].to_numpy() - x, axis=1)
    assert 0.04 <= i.radius <= 0.12
    assert abs(i.frac - got["gt"].mean()) < 1e-6 and i.frac > 0
    assert (moved[got["gt"] == 1] > 0.01 * i.radius * 0.99).all()
    assert (moved[got["gt"] == 0] <= 0.01 * i.radius * 1.01).all()
    r = np.linalg.norm(got[["x", "y", "z"]].to_numpy(), axis=1)[got["gt"] == 1]
    assert (r > 1).all() if i.kind == "bulge" else (r < 1).all()


def test_pseudo_tests_pair_every_normal_with_a_defect(spark):
    rng = np.random.default_rng(1)
    df = table(spark, sphere(rng, 1500), category="a", source_rank=0).unionByName(
        table(spark, sphere(rng, 1500), category="a", source_rank=1))
    for mode in ("view", "as_is"):
        got = S.pseudo_tests(df, ["category"], 3, mode, 7).groupBy("path", "label").agg(
            F.count(F.lit(1)).alias("n"), F.sum("gt").alias("gt"), F.max("x").alias("mx")).toPandas()
        assert len(got) == 6 and got.label.sum() == 3
        assert (got[got.label == 0]["gt"] == 0).all()
        full = got.n.max()
        assert full == 1500 if mode == "as_is" else (full < 1500)


def test_single_prototype_field_is_the_voxel(spark):
    frames = table(spark, sphere(np.random.default_rng(2), 1500), category="a", obj=0)
    f = T.build_tolerance(frames, voxel=0.05)
    s = f.scalars.toPandas().iloc[0]
    assert s.eps == 0.05 and s.uniform == s.spacing and s.u_mean == 0


def test_tolerance_field_raises_scores_at_a_bump(spark):
    rng = np.random.default_rng(3)
    frames = table(spark, sphere(rng, 2500), category="a", obj=0).unionByName(
        table(spark, sphere(rng, 2500), category="a", obj=1))
    f = T.build_tolerance(frames, voxel=0.05)
    s = f.scalars.toPandas().iloc[0]
    assert s.eps > 0 and s.uniform > 0 and s.n_surface > 500
    x, gt = sphere(rng, 2000, bump=True, with_gt=True)
    pts = table(spark, x, category="a", cloud_id="t")
    got = T.tolerance_scores(pts, f, ["category", "cloud_id"]).toPandas().sort_values("point_idx")
    assert len(got) == 2000
    for c in ("geo", "geou"):
        assert got[c][gt == 1].median() > 3 * got[c][gt == 0].median()
