"""Neighbour joins, greedy selection, memory and matching rules on the vector table.

Every row of the table is a memory entry: its first three dimensions are the position, its label the
physical object. Every row is also a query, compared with all entries but itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import memory as MEM
from ..operators.greedy import farthest_first
from ..operators.metric import min_distance
from ..operators.neighbours import neighbours, radius_summary, smooth
from .registry import query, r6, rounded, table

MEMORY = """
mem AS (SELECT vec_id, embedding[1]::DOUBLE AS cx, embedding[2]::DOUBLE AS cy, embedding[3]::DOUBLE AS cz,
  embedding::DOUBLE[] AS feat, label AS obj, (vec_id % 3)::INT AS vtype, (vec_id % 4)::INT AS sub FROM embeddings),
pairs AS (SELECT q.vec_id AS q, m.vec_id AS m, q.obj AS qobj, m.obj AS mobj, m.vtype, m.sub,
  sqrt((q.cx-m.cx)*(q.cx-m.cx) + (q.cy-m.cy)*(q.cy-m.cy) + (q.cz-m.cz)*(q.cz-m.cz)) AS dpos,
  list_distance(q.feat, m.feat) AS d FROM mem q, mem m)"""


def memory_table(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i)
    return e.select(
        F.lit("all").alias("category"), F.col("vec_id").alias("entry_id"), F.col("vec_id").alias("query_id"),
        at(1).alias("cx"), at(2).alias("cy"), at(3).alias("cz"), F.col("embedding").alias("feat"),
        F.col("label").alias("obj"), F.pmod("vec_id", F.lit(3)).cast("int").alias("vtype"),
        F.pmod("vec_id", F.lit(4)).cast("int").alias("sub"))


EVENT_POINTS = """
pt AS (SELECT user_id, event_id AS pid, event_type, value AS x, extract(day FROM ts) * 24 + extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE AS y,
  json_extract(props, '$.k')::DOUBLE AS z FROM events)"""


def event_points(spark, sf_dir):
    """Events of one user as a cloud: value, hour of the month, property k."""
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("pid"), "event_type", F.col("value").alias("x"),
        (F.dayofmonth("ts") * 24 + F.hour("ts") + F.minute("ts") / F.lit(60.0)).alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("z"))


@query("knn_join", f"""
WITH {EVENT_POINTS}
SELECT user_id, q AS qid, list(m ORDER BY d, m) AS nearest, round(max(d), 6) AS reach FROM (
  SELECT a.user_id, a.pid AS q, b.pid AS m, d.d, row_number() OVER (PARTITION BY a.user_id, a.pid ORDER BY d.d, b.pid) AS rn
  FROM pt a JOIN pt b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error',
  LATERAL (SELECT sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d) d) t
WHERE rn <= 3 GROUP BY ALL""")
def knn_join(spark, sf_dir):
    p = event_points(spark, sf_dir)
    near = neighbours(p.where("event_type = 'error'"), p.where("event_type <> 'error'"), 3, ["user_id"], "pid", "pid")
    # three entries per query
    return near.groupBy("user_id", "qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "rid"))), lambda s: s["rid"]).alias("nearest"),
        r6(F.max("dist"), "reach"))


@query("label_transfer", f"""
WITH {EVENT_POINTS}
SELECT moved, count(*) AS n, round(avg(d), 6) AS mean_dist FROM (
  SELECT a.pid, arg_min(b.event_type, (sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.pid)) AS moved,
    min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d
  FROM pt a JOIN pt b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' GROUP BY a.user_id, a.pid) t
GROUP BY moved""")
def label_transfer(spark, sf_dir):
    p = event_points(spark, sf_dir)
    near = neighbours(p.where("event_type = 'error'"), p.where("event_type <> 'error'"), 1, ["user_id"], "pid", "pid",
                      payload=["event_type"])
    return near.groupBy(F.col("event_type").alias("moved")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("dist"), "mean_dist"))


@query("point_interpolation", f"""
WITH {MEMORY}
SELECT q AS vec_id, round(avg(v), 6) AS score FROM (
  SELECT q, m, v, row_number() OVER (PARTITION BY q ORDER BY dpos, m) AS rn
  FROM pairs JOIN (SELECT vec_id, feat[4] AS v FROM mem) s ON s.vec_id = m) WHERE rn <= 12 GROUP BY q""")
def point_interpolation(spark, sf_dir):
    m = memory_table(spark, sf_dir).withColumn("v", F.element_at("feat", 4))
    near = neighbours(m, m, 12, ["category"], "entry_id", "entry_id", pos=("cx", "cy", "cz"))
    out = smooth(m.select("category", "entry_id", "v"), near, ["category"], "entry_id", ["v"], "vec_id")
    return out.select("vec_id", r6("v", "score"))


@query("leave_one_object_out_nearest", f"""
WITH {MEMORY} SELECT q AS vec_id, round(min(d), 6) AS dist FROM pairs WHERE qobj <> mobj GROUP BY q""")
def leave_one_object_out_nearest(spark, sf_dir):
    m = memory_table(spark, sf_dir)
    d = min_distance(m, m, ["category"], "entry_id", "entry_id", ("feat", "feat"), ("obj", "obj"))
    return d.select(F.col("entry_id").alias("vec_id"), r6("dist"))


@query("radius_join", f"""
WITH {MEMORY}
SELECT q AS vec_id, count(*) AS n, round(min(d), 6) AS nearest_feature, round(max(dpos), 6) AS reach
FROM pairs WHERE dpos <= 0.15 AND q <> m GROUP BY q""")
def radius_join(spark, sf_dir):
    m = memory_table(spark, sf_dir)
    around = radius_summary(m, m, 0.15, ["category"], "entry_id", "entry_id", pos=("cx", "cy", "cz"),
                            feat=("feat", "feat"), exclude=("entry_id", "entry_id"))
    return around.select(F.col("qid").alias("vec_id"), "n", r6("nearest", "nearest_feature"), r6("reach"))


FPS = """
RECURSIVE fps AS (
  SELECT 0 AS ord, e.label, e.vec_id, e.embedding::DOUBLE[] AS v, list_distance(e.embedding::DOUBLE[], s.v) AS mind, s.sid AS picked
  FROM embeddings e JOIN (SELECT label, min(vec_id) AS sid, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label) s
  USING (label)
  UNION ALL
  SELECT f.ord + 1, f.label, f.vec_id, f.v, least(f.mind, list_distance(f.v, p.v)), p.vec_id
  FROM fps f JOIN (SELECT label, vec_id, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mind DESC, vec_id) AS rn
       FROM fps) WHERE rn = 1) p USING (label) WHERE f.ord < 7)"""


@query("farthest_point_sampling", f"""
WITH {FPS} SELECT DISTINCT label, ord::BIGINT AS ord, picked AS vec_id FROM fps""")
def farthest_point_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    centres, _ = farthest_first(e, ["label"], "vec_id", F.col("embedding"), 8, dims=64)
    return centres.select("label", "ord", "vec_id")


@query("group_descriptors", f"""
WITH {FPS}, c AS (SELECT DISTINCT label, picked FROM fps),
near AS (SELECT c.label, c.picked, e.vec_id, e.embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY c.label, c.picked
   ORDER BY list_distance(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), e.vec_id) AS rn
   FROM c JOIN embeddings o ON o.vec_id = c.picked JOIN embeddings e ON e.label = c.label)
SELECT label, picked AS vec_id, dim - 1 AS dim, round(avg(x), 6) AS mean FROM (
  SELECT label, picked, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM near WHERE rn <= 16) GROUP BY ALL""")
def group_descriptors(spark, sf_dir):
    from ..operators.descriptors import mean_vectors
    e = table(spark, sf_dir, "embeddings")
    centres, _ = farthest_first(e, ["label"], "vec_id", F.col("embedding"), 8, dims=64)
    at = e.join(centres.select("label", "vec_id"), ["label", "vec_id"])
    near = neighbours(at, e, 16, ["label"], "vec_id", "vec_id", vec=("embedding", "embedding"),
                      payload=["embedding"])
    out = mean_vectors(near, ["label", "qid"], "embedding")
    return out.select("label", F.col("qid").alias("vec_id"), F.posexplode("embedding").alias("dim", "m")).select(
        "label", "vec_id", F.col("dim").cast("long").alias("dim"), r6("m", "mean"))


CORESET = """
h AS (SELECT vec_id, embedding::DOUBLE[] AS v, ('0x' || substr(md5('0|' || vec_id), 1, 8))::BIGINT AS hv FROM embeddings),
cs AS (
  SELECT 0 AS ord, e.vec_id, e.v, list_distance(e.v, s.v) AS mind, s.vec_id AS picked, cnt.m
  FROM h e, (SELECT vec_id, v FROM h ORDER BY hv, vec_id LIMIT 1) s,
       (SELECT greatest(1, floor(count(*) * 0.1))::INT AS m FROM h) cnt
  UNION ALL
  SELECT f.ord + 1, f.vec_id, f.v, least(f.mind, list_distance(f.v, p.v)), p.vec_id, f.m
  FROM cs f, (SELECT vec_id, v FROM cs ORDER BY mind DESC, vec_id LIMIT 1) p WHERE f.ord < f.m - 1),
bank AS (SELECT DISTINCT picked FROM cs)"""


@query("coreset_bank", f"""
WITH RECURSIVE {CORESET},
res AS (SELECT mind FROM cs WHERE ord = m - 1 AND mind > 0)
SELECT (SELECT count(*) FROM bank) AS size, (SELECT sum(picked) FROM bank)::DOUBLE AS id_sum, round(avg(mind), 6) AS mean,
  round(stddev_samp(mind), 6) AS std, round(quantile_cont(mind, 0.5), 6) AS p50, round(quantile_cont(mind, 0.9), 6) AS p90,
  round(quantile_cont(mind, 0.99), 6) AS p99 FROM res""")
def coreset_bank(spark, sf_dir):
    m = memory_table(spark, sf_dir)
    bank, ref = MEM.coreset(m, ["category"], "entry_id", "feat", 0.1)
    size = bank.groupBy("category").agg(F.count(F.lit(1)).alias("size"), F.sum("entry_id").cast("double").alias("id_sum"))
    return rounded(size.join(ref, "category").drop("category"), "mean", "std", "p50", "p90", "p99")


MASKED = """
n0 AS (SELECT count(*) FILTER (WHERE vtype = 0) AS n FROM mem),
eq AS (SELECT vec_id,
   row_number() OVER (ORDER BY vtype NOT IN (0, 1), md5('V01|31|' || vec_id)) AS r01, vtype IN (0, 1) AS b01,
   row_number() OVER (ORDER BY vtype NOT IN (0, 2), md5('V02|31|' || vec_id)) AS r02, vtype IN (0, 2) AS b02,
   row_number() OVER (ORDER BY md5('V012|31|' || vec_id)) AS r012 FROM mem),
msk AS (SELECT mem.*, vtype = 0 AS m_V0, vtype IN (0, 1) AS m_V01, vtype IN (0, 2) AS m_V02, vtype <> 1 OR sub < 2 AS m_M2,
   b01 AND r01 <= n AS m_V01_eq, b02 AND r02 <= n AS m_V02_eq, r012 <= n AS m_V012_eq
   FROM mem JOIN eq USING (vec_id), n0)"""


@query("memory_masks", f"""
WITH {MEMORY}, {MASKED}
SELECT vec_id, m_V0, m_V01, m_V02, true AS m_V012, m_M2, m_V01_eq, m_V02_eq, m_V012_eq FROM msk""")
def memory_masks(spark, sf_dir):
    m = MEM.memory_masks(memory_table(spark, sf_dir))
    return m.select(F.col("entry_id").alias("vec_id"), *[c for c in m.columns if c.startswith("m_")])


REFERENCE = """
ref AS (SELECT q AS vec_id, min(d) FILTER (WHERE dpos <= 0.1 AND qobj <> mobj) AS ref FROM pairs GROUP BY q),
alone AS (SELECT q, min(d) AS g FROM pairs WHERE qobj <> mobj GROUP BY q),
info AS (SELECT (SELECT quantile_disc(ref, 0.5) FROM ref) AS r_cat, (SELECT quantile_disc(g, 0.5) FROM alone) AS r_glob,
  (SELECT avg((ref IS NOT NULL)::INT) FROM ref) AS cov)"""


@query("normal_reference", f"""
WITH {MEMORY}, {REFERENCE}
SELECT vec_id, round(ref, 6) AS ref, round(r_cat, 6) AS ref_cat_median, round(r_glob, 6) AS ref_glob_median,
  round(cov, 6) AS ref_coverage FROM ref, info""")
def normal_reference(spark, sf_dir):
    m, info = MEM.build_reference(memory_table(spark, sf_dir))
    out = m.join(info, "category").select(F.col("entry_id").alias("vec_id"), "ref", *[c for c in info.columns if c != "category"])
    return rounded(out, "ref", "ref_cat_median", "ref_glob_median", "ref_coverage")


@query("matching_channels", f"""
WITH RECURSIVE {CORESET}, {MEMORY}, {MASKED}, {REFERENCE},
g AS (SELECT q, min(p.d) FILTER (WHERE p.m IN (SELECT picked FROM bank)) AS glob_cs, min(p.d) AS glob_full,
   min(p.d) FILTER (WHERE m_V0) AS glob_full_V0, min(p.d) FILTER (WHERE m_V01) AS glob_full_V01,
   min(p.d) FILTER (WHERE m_V02) AS glob_full_V02, min(p.d) FILTER (WHERE m_M2) AS glob_full_M2,
   min(p.d) FILTER (WHERE m_V01_eq) AS glob_full_V01_eq, min(p.d) FILTER (WHERE m_V02_eq) AS glob_full_V02_eq,
   min(p.d) FILTER (WHERE m_V012_eq) AS glob_full_V012_eq
   FROM pairs p JOIN msk ON msk.vec_id = p.m WHERE p.q <> p.m GROUP BY q),
cand AS (SELECT p.q, p.d, p.dpos, ref.ref, msk.*, row_number() OVER (PARTITION BY p.q ORDER BY p.dpos, p.m) AS rk
   FROM pairs p JOIN msk ON msk.vec_id = p.m JOIN ref ON ref.vec_id = p.m WHERE p.q <> p.m),
l AS (SELECT q, min(d) FILTER (WHERE dpos <= 0.05) AS loc05, min(d) FILTER (WHERE dpos <= 0.10) AS loc10,
   min(d) FILTER (WHERE dpos <= 0.15) AS loc15,
   min(d) FILTER (WHERE dpos <= 0.1 AND m_V0) AS l0, min(d) FILTER (WHERE dpos <= 0.1 AND m_V01) AS l01,
   min(d) FILTER (WHERE dpos <= 0.1 AND m_V02) AS l02, min(d) FILTER (WHERE dpos <= 0.1 AND m_M2) AS lm2,
   min(d) FILTER (WHERE dpos <= 0.1 AND m_V01_eq) AS l01e, min(d) FILTER (WHERE dpos <= 0.1 AND m_V02_eq) AS l02e,
   min(d) FILTER (WHERE dpos <= 0.1 AND m_V012_eq) AS l012e,
   min(d) FILTER (WHERE rk <= 64) AS knn64, min(d) FILTER (WHERE rk <= 256) AS knn256,
   min(d + 0.5 * r_cat * pow(dpos / 0.1, 2)) AS soft0p5, min(d + r_cat * pow(dpos / 0.1, 2)) AS soft1,
   min(d + 2 * r_cat * pow(dpos / 0.1, 2)) AS soft2,
   count(ref) FILTER (WHERE dpos <= 0.1) AS n, quantile_disc(ref, 0.5) FILTER (WHERE dpos <= 0.1) AS med,
   max(r_cat) AS r_cat, max(r_glob) AS r_glob
   FROM cand, info GROUP BY q),
c AS (SELECT *, coalesce(loc10, glob_cs) AS loc, coalesce(med, r_cat) AS mm FROM g LEFT JOIN l USING (q)),
k AS (SELECT *, loc / greatest((n * mm + 64 * r_cat) / (n + 64), 1e-9) AS cal10, loc / greatest(mm, 1e-9) AS cal10_k0 FROM c)
SELECT q AS query_id, round(glob_cs, 6) AS glob_cs, round(glob_full, 6) AS glob_full,
  round(glob_full_V0, 6) AS glob_full_V0, round(glob_full_V01, 6) AS glob_full_V01, round(glob_full_V02, 6) AS glob_full_V02,
  round(glob_full_M2, 6) AS glob_full_M2, round(glob_full_V01_eq, 6) AS glob_full_V01_eq,
  round(glob_full_V02_eq, 6) AS glob_full_V02_eq, round(glob_full_V012_eq, 6) AS glob_full_V012_eq,
  round(coalesce(loc05, glob_cs), 6) AS loc05, round(loc, 6) AS loc10, round(coalesce(loc15, glob_cs), 6) AS loc15,
  round(coalesce(l0, glob_full_V0), 6) AS loc10_V0, round(coalesce(l01, glob_full_V01), 6) AS loc10_V01,
  round(coalesce(l02, glob_full_V02), 6) AS loc10_V02, round(coalesce(lm2, glob_full_M2), 6) AS loc10_M2,
  round(coalesce(l01e, glob_full_V01_eq), 6) AS loc10_V01_eq, round(coalesce(l02e, glob_full_V02_eq), 6) AS loc10_V02_eq,
  round(coalesce(l012e, glob_full_V012_eq), 6) AS loc10_V012_eq, round(knn64, 6) AS knn64, round(knn256, 6) AS knn256,
  round(soft0p5, 6) AS soft0p5, round(soft1, 6) AS soft1, round(soft2, 6) AS soft2, round(cal10, 6) AS cal10,
  round(cal10_k0, 6) AS cal10_k0, round(sqrt(greatest(cal10, 0) * glob_full / r_glob), 6) AS hyb FROM k""")
def matching_channels(spark, sf_dir):
    m = memory_table(spark, sf_dir)
    bank, _ = MEM.coreset(m, ["category"], "entry_id", "feat", 0.1)
    with_ref, info = MEM.build_reference(m)
    masked = MEM.memory_masks(with_ref)
    out = C.score_channels(m, masked, bank, info, exclude=("query_id", "entry_id"))
    names = C.channel_columns(out, ["category", "query_id"])
    return rounded(out.select("query_id", *names), *names)
