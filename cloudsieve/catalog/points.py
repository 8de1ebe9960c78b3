"""Point-table cleaning and reduction: line items of one supplier form a cloud."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import preprocess as P
from .registry import query, r6, rounded, table
from .vectors import EVENT_POINTS, event_points

LINE_CLOUD = """
pt AS (SELECT l_suppkey, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_linenumber,
    round(l_extendedprice * 100)::BIGINT)), 1, 15))::BIGINT AS point_idx,
  l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, (l_returnflag = 'R')::INT AS gt FROM lineitem)"""


def line_cloud(spark, sf_dir):
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber")],
                            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("point_idx"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("gt"))


NORMALIZED = f"""
{LINE_CLOUD}, m AS (SELECT l_suppkey, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY 1),
s AS (SELECT l_suppkey, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS scale FROM pt JOIN m USING (l_suppkey) GROUP BY 1),
nm AS (SELECT l_suppkey, point_idx, gt, (x-mx)/scale AS x, (y-my)/scale AS y, (z-mz)/scale AS z
  FROM pt JOIN m USING (l_suppkey) JOIN s USING (l_suppkey))"""


@query("normalize_clouds", f"""
WITH {NORMALIZED} SELECT l_suppkey, point_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM nm""")
def normalize_clouds(spark, sf_dir):
    n = P.normalize(line_cloud(spark, sf_dir), ["l_suppkey"])
    return rounded(n.select("l_suppkey", "point_idx", "x", "y", "z"), "x", "y", "z")


@query("rigid_transform", f"""
WITH {NORMALIZED}
SELECT l_suppkey, point_idx, round(0.6*x - 0.8*y + 0.1, 6) AS x, round(0.8*x + 0.6*y - 0.2, 6) AS y, round(z + 0.3, 6) AS z FROM nm""")
def rigid_transform(spark, sf_dir):
    n = P.normalize(line_cloud(spark, sf_dir), ["l_suppkey"])
    pose = [0.6, -0.8, 0.0, 0.1, 0.8, 0.6, 0.0, -0.2, 0.0, 0.0, 1.0, 0.3, 0.0, 0.0, 0.0, 1.0]
    poses = n.select("l_suppkey").distinct().withColumn("pose", F.array(*[F.lit(v) for v in pose]))
    return rounded(P.transform(n, poses, ["l_suppkey"]).select("l_suppkey", "point_idx", "x", "y", "z"), "x", "y", "z")


@query("voxel_first_row", f"""
WITH {LINE_CLOUD}, c AS (SELECT l_suppkey, floor(x::FLOAT / 5::FLOAT) AS a, floor(y::FLOAT / 5::FLOAT) AS b,
  floor(z::FLOAT / 5::FLOAT) AS c, min(point_idx) AS point_idx, count(*) AS n FROM pt GROUP BY 1, 2, 3, 4)
SELECT l_suppkey, point_idx FROM c""")
def voxel_first_row(spark, sf_dir):
    return P.voxel_first(line_cloud(spark, sf_dir), ["l_suppkey"], 5.0).select("l_suppkey", "point_idx")


@query("voxel_centroid", f"""
WITH {LINE_CLOUD}, lo AS (SELECT l_suppkey, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pt GROUP BY 1)
SELECT l_suppkey, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pt JOIN lo USING (l_suppkey)
GROUP BY l_suppkey, floor((x - (lx - 4.0)) / 8.0), floor((y - (ly - 4.0)) / 8.0), floor((z - (lz - 4.0)) / 8.0)""")
def voxel_centroid(spark, sf_dir):
    return rounded(P.voxel_centroid(line_cloud(spark, sf_dir), ["l_suppkey"], 8.0).drop("cell"), "x", "y", "z")


@query("points_budget", f"""
WITH {EVENT_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('0|' || user_id || '|' || pid)) AS rn FROM pt)
SELECT user_id, pid FROM r WHERE rn <= 40""")
def points_budget(spark, sf_dir):
    return P.budget(event_points(spark, sf_dir), ["user_id"], 40, 0, "pid").select("user_id", "pid")


@query("bernoulli_thinning", f"""
WITH {EVENT_POINTS} SELECT user_id, pid FROM pt
WHERE ('0x' || substr(md5('3|' || user_id || '|' || pid), 1, 8))::BIGINT / 4294967296.0 < 0.5""")
def bernoulli_thinning(spark, sf_dir):
    return P.thin(event_points(spark, sf_dir), ["user_id"], 0.5, 3, "pid").select("user_id", "pid")


@query("visible_cap", f"""
WITH {LINE_CLOUD}, m AS (SELECT l_suppkey, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY 1)
SELECT l_suppkey, point_idx FROM pt JOIN m USING (l_suppkey)
WHERE ((x-mx)*0.6 + (z-mz)*0.8) / greatest(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)), 1e-9) > 0.15""")
def visible_cap(spark, sf_dir):
    return P.directional_view(line_cloud(spark, sf_dir), ["l_suppkey"], (0.6, 0.0, 0.8)).select("l_suppkey", "point_idx")


def _hn(axis: str, key: str) -> str:
    """Hashed normal number in DuckDB."""
    h = lambda s: f"(('0x' || substr(md5({key} || '|{axis}|{s}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return f"sqrt(-2.0 * ln(greatest({h('u')}, 1e-12))) * cos(6.283185307179586 * {h('v')})"


@query("directional_crop", f"""
WITH {EVENT_POINTS}, g AS (SELECT *, (event_type = 'error')::INT AS gt FROM pt),
m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sum(gt) AS nd FROM g GROUP BY 1),
v AS (SELECT m.*, d AS draw, {_hn('x', "'0|' || user_id || '|' || d")} AS a, {_hn('y', "'0|' || user_id || '|' || d")} AS b,
   {_hn('z', "'0|' || user_id || '|' || d")} AS c FROM m, range(20) t(d)),
p AS (SELECT g.user_id, pid, gt, nd, draw, ((x-mx)*a + (y-my)*b + (z-mz)*c) / sqrt(a*a+b*b+c*c)
   / greatest(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)), 1e-9) AS proj FROM g JOIN v USING (user_id)),
k AS (SELECT * FROM (SELECT *, quantile_cont(proj, 0.3129) OVER (PARTITION BY user_id, draw) AS cut FROM p) WHERE proj >= cut),
q AS (SELECT user_id, draw, sum(gt) AS kept, any_value(nd) AS nd FROM k GROUP BY ALL),
ch AS (SELECT user_id, coalesce(min(draw) FILTER (WHERE kept >= 0.5 * nd), arg_max(draw, (kept, -draw))) AS draw FROM q GROUP BY 1)
SELECT k.user_id, k.pid FROM k JOIN ch USING (user_id, draw)""")
def directional_crop(spark, sf_dir):
    p = event_points(spark, sf_dir).withColumn("gt", F.when(F.col("event_type") == "error", 1).otherwise(0))
    return P.directional_crop(p, ["user_id"], 0.6871).select("user_id", "pid")


@query("cloud_extent", f"""
WITH {LINE_CLOUD} SELECT l_suppkey, count(*) AS n_points,
  round(sqrt(pow(max(x)-min(x),2) + pow(max(y)-min(y),2) + pow(max(z)-min(z),2)), 6) AS diagonal FROM pt GROUP BY 1""")
def cloud_extent(spark, sf_dir):
    span = [F.max(c) - F.min(c) for c in P.XYZ]
    return line_cloud(spark, sf_dir).groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_points"), r6(X.norm3(*span), "diagonal"))


@query("organised_scan_filters", """
WITH p AS (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS x,
  CASE WHEN event_type = 'view' THEN 0 ELSE value / 2 END AS y,
  CASE WHEN event_type = 'click' THEN 'NaN'::DOUBLE WHEN event_type = 'view' THEN 0 ELSE 1 END AS z, event_id % 900 AS pix FROM events)
SELECT (pix // 30 < 5 OR pix // 30 >= 25 OR pix % 30 < 5 OR pix % 30 >= 25) AS border, count(*) AS n,
  sum(pix)::BIGINT AS pix_sum FROM p WHERE isfinite(z) AND (x <> 0 OR y <> 0 OR z <> 0) GROUP BY 1""")
def organised_scan_filters(spark, sf_dir):
    t = F.col("event_type")
    p = table(spark, sf_dir, "events").select(
        F.when(t == "view", 0.0).otherwise(F.col("value")).alias("x"),
        F.when(t == "view", 0.0).otherwise(F.col("value") / 2).alias("y"),
        F.when(t == "click", F.lit(float("nan"))).when(t == "view", 0.0).otherwise(1.0).alias("z"),
        F.pmod("event_id", F.lit(900)).alias("pix"))
    ok = P.drop_missing(p)
    return ok.groupBy(X.on_border("pix", F.lit(30), F.lit(30), 5).alias("border")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pix").alias("pix_sum"))


@query("mask_join", """
WITH mask AS (SELECT event_id AS pix, (event_type = 'error')::INT * 255 AS v FROM events WHERE event_type <> 'signup'),
p AS (SELECT o_orderkey, o_orderstatus, o_orderkey // 2 AS pix FROM orders)
SELECT o_orderstatus, count(*) AS n, sum((coalesce(v, 0) > 0)::INT)::BIGINT AS n_gt FROM p LEFT JOIN mask USING (pix) GROUP BY 1""")
def mask_join(spark, sf_dir):
    from ..sources.layouts import attach_mask
    mask = table(spark, sf_dir, "events").where("event_type <> 'signup'").select(
        F.col("event_id").alias("pix"), F.when(F.col("event_type") == "error", 255).otherwise(0).alias("mask"))
    p = table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.floor(F.col("o_orderkey") / 2).cast("long").alias("pix"))
    return attach_mask(p, mask, ["pix"]).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("gt").cast("long")).alias("n_gt"))


@query("sample_names", """
WITH p AS (SELECT page_id, url, string_split(url, '/') AS s FROM pages)
SELECT page_id, CASE WHEN len(s) >= 3 AND s[-2] = 'xyz' THEN s[-3] || '_' || s[-1] ELSE s[-1] END AS sample,
  regexp_replace(s[-1], '\\.[^.]*$', '') AS stem, md5(url)[1:8] AS path_hash FROM p""")
def sample_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", X.sample_id("url").alias("sample"), X.file_stem("url").alias("stem"),
        F.substring(F.md5("url"), 1, 8).alias("path_hash"))


@query("pose_distance", """
WITH a AS (SELECT c_custkey, (c_acctbal / 1000) AS t, c_nationkey / 10.0::DOUBLE AS s FROM customer)
SELECT c_custkey, round(degrees(acos(greatest(-1.0, least(1.0, (2 * cos(t) + 1 - 1) / 2)))) + 200 * abs(s), 6) AS d FROM a""")
def pose_distance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("t"), (F.col("c_nationkey") / F.lit(10.0)).alias("s"))
    zero, one = F.lit(0.0), F.lit(1.0)
    rot = X.rotation_entries((zero, zero, one), "t")
    pose = F.array(*rot[0:3], "s", *rot[3:6], zero, *rot[6:9], zero, zero, zero, zero, one)
    same = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    return c.select("c_custkey", r6(X.pose_distance(pose, same), "d"))


@query("prototype_selection", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (WHERE rk = 1) AS frame, count(*) FILTER (WHERE rk <= 4) AS n_protos,
  count(*) FILTER (WHERE rk > 4 AND rk <= 6) AS n_extra FROM r GROUP BY 1""")
def prototype_selection(spark, sf_dir):
    from ..sources.layouts import ranked, take_slice
    o = ranked(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    first = o.where("cloud_rank = 1").select("o_custkey", F.col("o_orderkey").alias("frame"))
    protos = take_slice(o, 0, 4).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_protos"))
    extra = take_slice(o, 4, 2).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_extra"))
    return first.join(protos, "o_custkey").join(extra, "o_custkey", "left").withColumn(
        "n_extra", F.coalesce("n_extra", F.lit(0)))
