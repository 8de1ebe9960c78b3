"""Geometry, registration, clean-up and the whole pipeline on clouds derived from the given tables.

Queries whose kernels use random draws or eigenvectors have no SQL twin; their operators are tested
against brute force on small shapes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash01
from ..operators import cleanup as CL
from ..operators import preprocess as P
from ..operators import registration as R
from ..operators import rigid as RG
from ..operators import synth as S
from ..operators import tolerance as T
from ..operators.descriptors import normals, sample_features
from ..operators.matching import ball_minima
from ..operators.neighbours import neighbours
from ..plans import diagnostics as DG
from ..session import cut_lineage
from .points import NORMALIZED, _hn, line_cloud
from .registry import query, r6, rounded, table
from .vectors import EVENT_POINTS, MEMORY, event_points, memory_table


def unit_event_clouds(spark, sf_dir):
    e = event_points(spark, sf_dir).withColumnRenamed("pid", "point_idx")
    return P.normalize(e, ["user_id"])


@query("other_surface_minimum", f"""
WITH {EVENT_POINTS} SELECT a.user_id, a.pid, round(min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))), 6) AS d
FROM pt a JOIN pt b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY ALL""")
def other_surface_minimum(spark, sf_dir):
    p = event_points(spark, sf_dir)
    near = neighbours(p, p, 1, ["user_id"], "pid", "pid", exclude=("event_type", "event_type"))
    return near.select("user_id", F.col("qid").alias("pid"), r6("dist", "d"))


@query("point_to_surface", f"""
WITH {EVENT_POINTS}, n AS (SELECT a.user_id, a.pid, arg_min((b.x, b.y, b.z), (sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.pid)) AS s,
   any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z FROM pt a JOIN pt b ON a.user_id = b.user_id
   AND a.event_type = 'error' AND b.event_type <> 'error' GROUP BY a.user_id, a.pid),
d AS (SELECT user_id, pid, x - s[1] AS dx, y - s[2] AS dy, z - s[3] AS dz FROM n),
o AS (SELECT user_id, pid, abs(0.6*dx + 0.8*dz) AS off, dx*dx + dy*dy + dz*dz AS d2 FROM d)
SELECT user_id, pid, round(off + greatest(sqrt(greatest(d2 - off*off, 0)) - 2.5, 0), 5) AS r FROM o""")
def point_to_surface(spark, sf_dir):
    p = event_points(spark, sf_dir)
    q = p.where("event_type = 'error'").select("user_id", "pid", *[F.col(c).alias(f"q{c}") for c in P.XYZ])
    s = p.where("event_type <> 'error'").withColumns({"nx": F.lit(0.6), "ny": F.lit(0.0), "nz": F.lit(0.8)})
    near = neighbours(q, s, 1, ["user_id"], "pid", "pid", pos=("qx", "qy", "qz"), r_pos=P.XYZ,
                      payload=[*P.XYZ, *T.NORMAL], carry=["qx", "qy", "qz"])
    return near.select("user_id", F.col("qid").alias("pid"), F.round(T.point_to_surface(near, F.lit(2.5)), 5).alias("r"))


@query("pose_selection", f"""
WITH {EVENT_POINTS}, po AS (SELECT * FROM (VALUES (0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0)) t(pose_idx, c, s)),
src AS (SELECT user_id, pid, pose_idx, c*x - s*y AS x, s*x + c*y AS y, z FROM pt, po WHERE event_type = 'error'),
d AS (SELECT s.user_id, s.pose_idx, s.pid, min(sqrt((s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) + (s.z-t.z)*(s.z-t.z))) AS d
  FROM src s JOIN pt t ON s.user_id = t.user_id AND t.event_type <> 'error' GROUP BY ALL),
r AS (SELECT user_id, pose_idx, quantile_cont(d, 0.9) AS res FROM d GROUP BY ALL)
SELECT user_id, arg_min(pose_idx, (res, pose_idx)) AS pose_idx, round(min(res), 6) AS reg_res,
  round(arg_min(res, pose_idx), 6) AS reg_res_first, count(*) AS n_hyp FROM r GROUP BY user_id""")
def pose_selection(spark, sf_dir):
    p = event_points(spark, sf_dir)
    turn = lambda c, s: F.array(*[F.lit(float(v)) for v in (c, -s, 0, 0, s, c, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    poses = F.array(*[F.struct(F.lit(i).alias("pose_idx"), F.lit(i).alias("gen_idx"), t.alias("pose"), F.lit(1.0).alias("fitness"))
                      for i, t in enumerate((turn(1, 0), turn(0, 1), turn(-1, 0)))])
    source = p.where("event_type = 'error'")
    cand = source.select("user_id").distinct().select("user_id", F.inline(poses))
    # a voxel far below the point distance keeps every point
    res = R.residuals(source, p.where("event_type <> 'error'"), cand, ["user_id"], ["user_id"], 1e-5)
    out = R.select_pose(cand, res, ["user_id"])
    return out.select("user_id", "pose_idx", r6("reg_res"), r6("reg_res_first"), "n_hyp")


@query("local_rule_candidates", f"""
WITH {MEMORY}, near AS (SELECT * FROM pairs WHERE q <> m)
SELECT r, round(avg(n), 6) AS mean_candidates, count(*) FILTER (WHERE n = 0) AS n_fallback FROM (
  SELECT q, r, count(*) FILTER (WHERE dpos <= r) AS n FROM near, (VALUES (0.05), (0.1), (0.15)) t(r) GROUP BY ALL)
GROUP BY r""".replace("SELECT r, round", "SELECT r::DOUBLE AS r, round"))
def local_rule_candidates(spark, sf_dir):
    m = memory_table(spark, sf_dir)
    radii = F.array(*[F.struct(F.lit(r).alias("r"), F.coalesce(F.col(f"c{i}_candidates"), F.lit(0)).alias("n"))
                      for i, r in enumerate((0.05, 0.10, 0.15))])
    found = ball_minima(m, m, ["category"], "entry_id", "entry_id", {f"c{i}": r for i, r in enumerate((0.05, 0.10, 0.15))},
                        exclude=("entry_id", "entry_id"))
    each = m.select("category", "entry_id").join(found, ["category", "entry_id"], "left")
    return each.select(F.inline(radii)).groupBy("r").agg(
        r6(F.avg("n"), "mean_candidates"), F.count_if(F.col("n") == 0).alias("n_fallback"))


@query("simulated_cuts", f"""
WITH {NORMALIZED}, dr AS (SELECT l_suppkey, d AS sub, {_hn('x', "'1234|' || l_suppkey || '|' || d")} AS a,
  {_hn('y', "'1234|' || l_suppkey || '|' || d")} AS b, {_hn('z', "'1234|' || l_suppkey || '|' || d")} AS c
  FROM (SELECT DISTINCT l_suppkey FROM nm), range(3) t(d)),
k AS (SELECT l_suppkey, sub, point_idx FROM nm JOIN dr USING (l_suppkey)
  WHERE (x*a + y*b + z*c) / sqrt(a*a+b*b+c*c) / greatest(sqrt(x*x+y*y+z*z), 1e-9) > 0.15)
SELECT l_suppkey, sub, count(*) AS n, min(point_idx) AS first_point FROM k GROUP BY ALL HAVING count(*) >= 200""")
def simulated_cuts(spark, sf_dir):
    n = cut_lineage(P.normalize(line_cloud(spark, sf_dir), ["l_suppkey"]).withColumn("obj", F.col("l_suppkey")))
    cuts = P.simulated_cuts(n, ["l_suppkey"], 3)
    return cuts.groupBy("l_suppkey", "sub").agg(F.count(F.lit(1)).alias("n"), F.min("point_idx").alias("first_point"))


@query("gaussian_noise", f"""
WITH {EVENT_POINTS} SELECT user_id, pid, round(x + 0.5 * {_hn('x', "'5|' || user_id || '|' || pid")}, 6) AS x,
  round(z + 0.5 * {_hn('z', "'5|' || user_id || '|' || pid")}, 6) AS z FROM pt""")
def gaussian_noise(spark, sf_dir):
    p = P.add_noise(event_points(spark, sf_dir), ["user_id"], 0.5, 5, "pid")
    return rounded(p.select("user_id", "pid", "x", "z"), "x", "z")


@query("strided_subsample", """
WITH n AS (SELECT greatest(1, count(*) // 300) AS step FROM events)
SELECT event_id, user_id FROM events, n WHERE event_id % step = 0""")
def strided_subsample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit(0).alias("g"))
    return P.stride(e, ["g"], "event_id", 300).select("event_id", "user_id")


@query("holdout_scan_rule", """
WITH r AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS rmse, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY rmse, l_returnflag) AS rn FROM r),
a AS (SELECT l_suppkey, max(l_returnflag) FILTER (WHERE rn = 1) AS owner, min(rmse) AS best,
  max(rmse) FILTER (WHERE rn = 2) / min(rmse) AS ratio, max(rmse) FILTER (WHERE l_returnflag = 'N') AS h, sum(n) AS n FROM k GROUP BY 1)
SELECT l_suppkey, owner = 'N' AND ratio >= 1.01 AS pseudo_test,
  NOT (owner = 'N' AND ratio >= 1.01) AND h >= 1.01 * best AND n >= 200 AS in_memory FROM a""")
def holdout_scan_rule(spark, sf_dir):
    from ..operators.memory import assign_owner, memory_scans
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", flag.alias("obj"), "l_extendedprice")
    fits = line.groupBy("l_suppkey", "obj").agg(F.avg("l_extendedprice").alias("rmse"))
    held = fits.where("obj = 1").select("l_suppkey", F.col("rmse").alias("holdout_rmse"))
    size = line.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_points"))
    a = assign_owner(fits, ["l_suppkey"], "obj", "rmse").join(held, "l_suppkey", "left").join(size, "l_suppkey")
    return memory_scans(a, 1, margin=1.01).select("l_suppkey", "pseudo_test", "in_memory")


CLUSTERS = f"""{EVENT_POINTS},
m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY 1),
s AS (SELECT user_id, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS sc FROM pt JOIN m USING (user_id) GROUP BY 1),
u AS (SELECT user_id, pid, (x-mx)/sc AS x, (y-my)/sc AS y, (z-mz)/sc AS z FROM pt JOIN m USING (user_id) JOIN s USING (user_id)),
e AS (SELECT user_id, sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)) AS ext FROM u GROUP BY 1),
pr AS (SELECT a.user_id, a.pid AS q, b.pid AS r FROM u a JOIN u b USING (user_id) JOIN e USING (user_id)
  WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) / ext <= 0.12),
co AS (SELECT user_id, q AS pid FROM pr GROUP BY ALL HAVING count(*) >= 5),
ed AS (SELECT pr.user_id, q, r FROM pr JOIN co a ON a.user_id = pr.user_id AND a.pid = q JOIN co b ON b.user_id = pr.user_id AND b.pid = r),
re AS (SELECT user_id, pid AS a, pid AS b FROM co UNION SELECT re.user_id, re.a, ed.r FROM re JOIN ed ON re.user_id = ed.user_id AND re.b = ed.q),
lb AS (SELECT user_id, a AS pid, min(b) AS cluster FROM re GROUP BY ALL),
tc AS (SELECT pr.user_id, q AS pid, min(cluster) AS t FROM pr JOIN lb ON lb.user_id = pr.user_id AND lb.pid = pr.r GROUP BY ALL),
cl AS (SELECT tc.user_id, tc.pid AS point_idx, coalesce(lb.cluster, tc.t) AS cluster FROM tc LEFT JOIN lb USING (user_id, pid))"""


@query("density_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT user_id, point_idx, cluster FROM cl")
def density_clusters(spark, sf_dir):
    return CL.density_clusters(cut_lineage(unit_event_clouds(spark, sf_dir)), ["user_id"], 0.12)


@query("cluster_clean_up", f"""
WITH RECURSIVE {CLUSTERS},
cn AS (SELECT user_id, count(*) AS n FROM pt GROUP BY 1),
cc AS (SELECT user_id, cluster, count(*) AS c FROM cl JOIN cn USING (user_id) WHERE n > 50 GROUP BY ALL),
kc AS (SELECT user_id, cluster FROM (SELECT *, max(c) OVER (PARTITION BY user_id) AS m FROM cc) WHERE c >= 0.05 * m)
SELECT user_id, point_idx FROM cl JOIN kc USING (user_id, cluster)
UNION ALL SELECT user_id, pid FROM pt WHERE user_id NOT IN (SELECT user_id FROM cc)""")
def cluster_clean_up(spark, sf_dir):
    return CL.drop_small_clusters(cut_lineage(unit_event_clouds(spark, sf_dir)), ["user_id"], radius_share=0.12).select(
        "user_id", "point_idx")


@query("normal_spread", f"""
WITH {EVENT_POINTS},
m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY 1),
s AS (SELECT user_id, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS sc FROM pt JOIN m USING (user_id) GROUP BY 1),
u AS (SELECT user_id, pid, (x-mx)/sc AS x, (y-my)/sc AS y, (z-mz)/sc AS z FROM pt JOIN m USING (user_id) JOIN s USING (user_id)),
nn AS (SELECT a.user_id, a.pid, b.x - a.x AS x, b.y - a.y AS y, b.z - a.z AS z, row_number() OVER (PARTITION BY a.user_id, a.pid
  ORDER BY sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), b.pid) AS rn FROM u a JOIN u b USING (user_id)),
c AS (SELECT user_id, pid, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy,
  covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM nn WHERE rn <= 10 GROUP BY ALL),
e AS (SELECT *, (xx + yy + zz) / 3 AS t, xx*yy + yy*zz + zz*xx - xy*xy - xz*xz - yz*yz AS k2,
  xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS k3 FROM c),
r AS (SELECT *, sqrt(greatest(t*t - k2 / 3, 0)) AS p FROM e),
v AS (SELECT *, CASE WHEN p < 1e-12 THEN t ELSE t + 2*p*cos((acos(greatest(-1, least(1, (2*t*t*t - t*k2 + k3) / (2*p*p*p)))) + 2*pi()) / 3) END AS least_ FROM r)
SELECT user_id, pid AS point_idx, round(CASE WHEN n < 3 THEN zz ELSE least_ END, 5) AS spread FROM v""")
def normal_spread(spark, sf_dir):
    """Variance of the ten nearest points along the normal: the smallest eigenvalue of their covariance."""
    cloud = cut_lineage(unit_event_clouds(spark, sf_dir))
    n = normals(cloud, ["user_id"], 10).select("user_id", "point_idx", *[F.col(c).alias(f"q{c}") for c in P.XYZ], "nx", "ny", "nz")
    near = neighbours(n, cloud, 10, ["user_id"], "point_idx", "point_idx", pos=("qx", "qy", "qz"), r_pos=P.XYZ, payload=P.XYZ,
                      carry=["qx", "qy", "qz", "nx", "ny", "nz"])
    along = sum(((F.col(c) - F.col(f"q{c}")) * F.col(f"n{c}") for c in P.XYZ), F.lit(0.0))
    return near.groupBy("user_id", F.col("qid").alias("point_idx")).agg(F.round(F.greatest(F.var_pop(along), F.lit(0.0)), 5).alias("spread"))


def _axis(lam: str, src: str, name: str, kept: str) -> str:
    """CTEs that give the unit eigenvector (nx, ny, nz) of ``src``'s covariance for the eigenvalue ``lam``: the longest cross product of rows."""
    return f"""
{name}_c AS (SELECT *, {lam} AS la FROM {src}),
{name}_x AS (SELECT *, xy*yz - xz*(yy-la) AS ux, xz*xy - (xx-la)*yz AS uy, (xx-la)*(yy-la) - xy*xy AS uz,
  xy*(zz-la) - xz*yz AS vx, xz*xz - (xx-la)*(zz-la) AS vy, (xx-la)*yz - xy*xz AS vz,
  (yy-la)*(zz-la) - yz*yz AS wx, yz*xz - xy*(zz-la) AS wy, xy*yz - (yy-la)*xz AS wz FROM {name}_c),
{name}_l AS (SELECT *, ux*ux+uy*uy+uz*uz AS lu, vx*vx+vy*vy+vz*vz AS lv, wx*wx+wy*wy+wz*wz AS lw FROM {name}_x),
{name} AS (SELECT {kept}, CASE WHEN lu >= lv AND lu >= lw THEN ux / sqrt(lu) WHEN lv >= lw THEN vx / sqrt(lv) ELSE wx / sqrt(lw) END AS nx,
  CASE WHEN lu >= lv AND lu >= lw THEN uy / sqrt(lu) WHEN lv >= lw THEN vy / sqrt(lv) ELSE wy / sqrt(lw) END AS ny,
  CASE WHEN lu >= lv AND lu >= lw THEN uz / sqrt(lu) WHEN lv >= lw THEN vz / sqrt(lv) ELSE wz / sqrt(lw) END AS nz FROM {name}_l)"""


_MOMENTS = "user_id, pid, n, x, y, z, xx, xy, xz, yy, yz, zz"
_QUOTIENT = "xx*nx*nx + yy*ny*ny + zz*nz*nz + 2*(xy*nx*ny + xz*nx*nz + yz*ny*nz)"


def _normals(moments: str, kept: str, sign: str, few: str = "1") -> str:
    """CTEs from covariances (``moments``) to oriented points o: a closed form of the eigenvector and two steps that refine it."""
    return f"""
k3 AS (SELECT *, (xx + yy + zz) / 3 AS t, xx*yy + yy*zz + zz*xx - xy*xy - xz*xz - yz*yz AS k2,
  xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS kd FROM {moments}),
kp AS (SELECT *, sqrt(greatest(t*t - k2 / 3, 1e-300)) AS h FROM k3),
{_axis("t + 2*h*cos((acos(greatest(-1, least(1, (2*t*t*t - t*k2 + kd) / (2*h*h*h)))) + 2*pi()) / 3)", "kp", "e0", kept)},
{_axis(_QUOTIENT, "e0", "e1", kept)}, {_axis(_QUOTIENT, "e1", "e2", kept)},
o AS (SELECT * EXCLUDE (nx, ny, nz, g, n, xx, xy, xz, yy, yz, zz), CASE WHEN n < 3 THEN 0 ELSE g * nx END AS nx, CASE WHEN n < 3 THEN 0 ELSE g * ny END AS ny,
  CASE WHEN n < 3 THEN {few} ELSE g * nz END AS nz
  FROM (SELECT *, CASE WHEN {sign} < 0 THEN -1 ELSE 1 END AS g FROM e2))"""


def _oriented(neighbours_: int, few: str = "1") -> str:
    """CTEs from the event points to oriented ones: unit frame u, lists nn, normals o."""
    return f"""
mn AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pt GROUP BY 1),
sc AS (SELECT user_id, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS sc FROM pt JOIN mn USING (user_id) GROUP BY 1),
u AS (SELECT user_id, pid, (x-mx)/sc AS x, (y-my)/sc AS y, (z-mz)/sc AS z FROM pt JOIN mn USING (user_id) JOIN sc USING (user_id)),
pw AS (SELECT a.user_id, a.pid AS p, b.pid AS q, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, a.x, a.y, a.z,
  (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM u a JOIN u b USING (user_id)),
nn AS (SELECT *, row_number() OVER (PARTITION BY user_id, p ORDER BY d2, q) AS rn FROM pw),
cv AS (SELECT user_id, p AS pid, count(*) AS n, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, covar_pop(dx, dx) AS xx, covar_pop(dx, dy) AS xy,
  covar_pop(dx, dz) AS xz, covar_pop(dy, dy) AS yy, covar_pop(dy, dz) AS yz, covar_pop(dz, dz) AS zz FROM nn WHERE rn <= {neighbours_} GROUP BY ALL),
{_normals("cv", _MOMENTS, "nx*x + ny*y + nz*z", few)}"""


@query("surface_normals", f"""
WITH {EVENT_POINTS}, {_oriented(10)}
SELECT user_id, pid AS point_idx, round(nx, 5) AS nx, round(ny, 5) AS ny, round(nz, 5) AS nz FROM o""")
def surface_normals(spark, sf_dir):
    n = normals(cut_lineage(unit_event_clouds(spark, sf_dir)), ["user_id"], 10)
    return n.select("user_id", "point_idx", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query("cloud_descriptors", f"""
WITH RECURSIVE {EVENT_POINTS}, {_oriented(10, "CASE WHEN z < 0 THEN -1 ELSE 1 END")},
li AS (SELECT user_id, p, q, d2, dx, dy, dz, rn FROM nn WHERE rn BETWEEN 2 AND 20),
pa AS (SELECT l.*, a.nx AS ax, a.ny AS ay, a.nz AS az, b.nx AS bx, b.ny AS by_, b.nz AS bz, dx/r AS ex, dy/r AS ey, dz/r AS ez
  FROM (SELECT *, CASE WHEN d2 > 0 THEN sqrt(d2) ELSE 1 END AS r FROM li) l
  JOIN o a ON a.user_id = l.user_id AND a.pid = l.p JOIN o b ON b.user_id = l.user_id AND b.pid = l.q),
pb AS (SELECT *, ax*ex + ay*ey + az*ez AS a, bx*ex + by_*ey + bz*ez AS b FROM pa),
pc AS (SELECT *, abs(b) - abs(a) > 1e-9 AS sw FROM pb),
pd AS (SELECT user_id, p, q, d2, rn, CASE WHEN sw THEN -b ELSE a END AS phi, CASE WHEN sw THEN -ex ELSE ex END AS ex, CASE WHEN sw THEN -ey ELSE ey END AS ey,
  CASE WHEN sw THEN -ez ELSE ez END AS ez, CASE WHEN sw THEN bx ELSE ax END AS sx, CASE WHEN sw THEN by_ ELSE ay END AS sy, CASE WHEN sw THEN bz ELSE az END AS sz,
  CASE WHEN sw THEN ax ELSE bx END AS tx, CASE WHEN sw THEN ay ELSE by_ END AS ty, CASE WHEN sw THEN az ELSE bz END AS tz FROM pc),
pe AS (SELECT *, ey*sz - ez*sy AS vx0, ez*sx - ex*sz AS vy0, ex*sy - ey*sx AS vz0 FROM pd),
pf AS (SELECT *, sqrt(vx0*vx0 + vy0*vy0 + vz0*vz0) AS le FROM pe),
pg AS (SELECT *, d2 > 0 AND le > 1e-9 AS ok, vx0 / greatest(le, 1e-300) AS vx, vy0 / greatest(le, 1e-300) AS vy, vz0 / greatest(le, 1e-300) AS vz FROM pf),
ph AS (SELECT user_id, p, q, d2, rn, CASE WHEN ok THEN atan2((sy*vz - sz*vy)*tx + (sz*vx - sx*vz)*ty + (sx*vy - sy*vx)*tz, sx*tx + sy*ty + sz*tz) ELSE 0 END AS theta,
  CASE WHEN ok THEN vx*tx + vy*ty + vz*tz ELSE 0 END AS alpha, CASE WHEN ok THEN phi ELSE 0 END AS phi FROM pg),
bi AS (SELECT user_id, p, q, rn, unnest([0, 11, 22]) AS o11,
  unnest([least(10, greatest(0, floor(11 * (CASE WHEN theta < 1e-9 - pi() THEN pi() ELSE theta END + pi()) / (2 * pi())))), least(10, greatest(0, floor(11 * (alpha + 1) / 2))),
          least(10, greatest(0, floor(11 * (phi + 1) / 2)))])::INTEGER AS bin FROM ph),
si AS (SELECT user_id, p, s, 33 * s + o11 + bin AS dim, count(*) AS c FROM bi, (VALUES (0), (1)) t(s) WHERE rn <= 10 * (s + 1) GROUP BY ALL),
le AS (SELECT user_id, p, s, count(*) AS m FROM li, (VALUES (0), (1)) t(s) WHERE rn <= 10 * (s + 1) GROUP BY ALL),
sh AS (SELECT si.user_id, si.p, si.s, dim, 100.0::DOUBLE / m * c AS v FROM si JOIN le USING (user_id, p, s)),
wf AS (SELECT li.user_id, li.p, s, dim, sum(v / d2) AS f FROM li JOIN sh ON sh.user_id = li.user_id AND sh.p = li.q AND rn <= 10 * (s + 1) WHERE d2 > 0 GROUP BY ALL),
wt AS (SELECT *, sum(f) OVER (PARTITION BY user_id, p, dim // 11) AS tot FROM wf),
ft AS (SELECT user_id, p, dim, sum(v) AS v FROM (SELECT user_id, p, dim, v FROM sh UNION ALL SELECT user_id, p, dim, f * 100 / tot FROM wt WHERE tot > 0) GROUP BY ALL),
cnt AS (SELECT user_id, count(*) AS n, min(pid) AS f0 FROM u GROUP BY 1),
fp AS (
  SELECT 0 AS ord, pw.user_id, q AS pid, d2 AS mind, p AS picked, n FROM pw JOIN cnt USING (user_id) WHERE p = f0
  UNION ALL
  SELECT fp.ord + 1, fp.user_id, fp.pid, least(fp.mind, pw.d2), g.pid, fp.n FROM fp
  JOIN (SELECT user_id, pid FROM (SELECT user_id, pid, row_number() OVER (PARTITION BY user_id ORDER BY mind DESC, pid) AS rk FROM fp) WHERE rk = 1) g USING (user_id)
  JOIN pw ON pw.user_id = fp.user_id AND pw.p = g.pid AND pw.q = fp.pid WHERE fp.ord < least(16, fp.n) - 1),
ce AS (SELECT DISTINCT user_id, ord, picked, n FROM fp)
SELECT ce.user_id, ord::BIGINT AS center_idx, dim::INTEGER AS dim, round(sum(v) / any_value(least(8, ce.n)), 5) AS value
FROM ce JOIN nn ON nn.user_id = ce.user_id AND nn.p = ce.picked AND nn.rn <= 8 JOIN ft ON ft.user_id = nn.user_id AND ft.p = nn.q GROUP BY ALL HAVING sum(v) > 0""")
def cloud_descriptors(spark, sf_dir):
    """Non-zero entries of the mean descriptor around every centre."""
    out = sample_features(unit_event_clouds(spark, sf_dir), ["user_id"], 10, 2, 16, 8, kind="double")
    out = out.select("user_id", "center_idx", F.posexplode("feat").alias("dim", "value")).where("value > 0")
    return out.select("user_id", "center_idx", "dim", F.round("value", 5).alias("value"))


def _h01(*parts: str) -> str:
    """Hashed uniform number in DuckDB."""
    return f"(('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("injected_defects", f"""
WITH {EVENT_POINTS}, {_oriented(20)},
dc AS (SELECT user_id, arg_min((x, y, z), md5('0|' || user_id || '|' || pid)) AS c FROM u GROUP BY 1),
um AS (SELECT user_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM u GROUP BY 1),
us AS (SELECT user_id, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS s0 FROM u JOIN um USING (user_id) GROUP BY 1),
d0 AS (SELECT user_id, c, CASE WHEN s0 > 0 THEN s0 ELSE 1 END AS s FROM dc JOIN us USING (user_id)),
dr AS (SELECT *, (0.04 + {_h01("'0'", "user_id", "'radius'")} * (0.12 - 0.04)) * s AS r,
  CASE WHEN {_h01("'0'", "user_id", "'kind'")} < 0.5 THEN 1.0 ELSE -1.0 END AS g FROM d0),
da AS (SELECT *, (0.25 + {_h01("'0'", "user_id", "'amplitude'")} * (0.6 - 0.25)) * r * g AS amp FROM dr),
pw2 AS (SELECT o.*, r, amp, ((o.x-c[1])*(o.x-c[1]) + (o.y-c[2])*(o.y-c[2]) + (o.z-c[3])*(o.z-c[3])) / (r*r) AS q FROM o JOIN da USING (user_id)),
we AS (SELECT *, greatest(1 - q, 0) * greatest(1 - q, 0) AS w FROM pw2),
mv AS (SELECT *, CASE WHEN count(*) FILTER (w > 0) OVER (PARTITION BY user_id) >= 3 THEN amp * w ELSE 0 END AS d FROM we)
SELECT user_id, pid AS point_idx, round(x + d * nx, 5) AS x, round(y + d * ny, 5) AS y, round(z + d * nz, 5) AS z,
  (abs(d) * sqrt(nx*nx + ny*ny + nz*nz) > 0.01 * r)::INTEGER AS gt FROM mv""")
def injected_defects(spark, sf_dir):
    """Every cloud with its surface pushed out or in around a drawn point, and the points that count as defect."""
    out, _ = S.inject_defect(cut_lineage(unit_event_clouds(spark, sf_dir)), ["user_id"], 0)
    return out.select("user_id", "point_idx", *[F.round(c, 5).alias(c) for c in P.XYZ], F.col("gt").cast("int").alias("gt"))


@query("support_plane_removal", """
WITH a AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_linestatus = 'F' AS border FROM lineitem),
ex AS (SELECT l_suppkey, sqrt(pow(max(x)-min(x), 2) + pow(max(y)-min(y), 2) + pow(max(z)-min(z), 2)) AS e0 FROM a GROUP BY 1),
ext AS (SELECT l_suppkey, CASE WHEN e0 > 0 THEN e0 ELSE 1 END AS e FROM ex),
bo AS (SELECT l_suppkey, x, y, z, row_number() OVER (PARTITION BY l_suppkey ORDER BY z, y, x) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n
  FROM a WHERE border),
big AS (SELECT DISTINCT l_suppkey, n FROM bo WHERE n >= 100),
dr AS (SELECT l_suppkey, t, j, floor(('0x' || substr(md5('0|' || l_suppkey || '|' || t || '|' || j), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS i
  FROM big, range(1000) s(t), range(3) r(j)),
tr AS (SELECT d.l_suppkey, t, max(x) FILTER (j = 0) AS x0, max(y) FILTER (j = 0) AS y0, max(z) FILTER (j = 0) AS z0,
  max(x) FILTER (j = 1) AS x1, max(y) FILTER (j = 1) AS y1, max(z) FILTER (j = 1) AS z1, max(x) FILTER (j = 2) AS x2, max(y) FILTER (j = 2) AS y2,
  max(z) FILTER (j = 2) AS z2 FROM dr d JOIN bo USING (l_suppkey, i) GROUP BY ALL),
cr AS (SELECT l_suppkey, t, x0, y0, z0, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS b,
  (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS c FROM tr),
pl AS (SELECT *, sqrt(a*a + b*b + c*c) AS l FROM cr WHERE sqrt(a*a + b*b + c*c) > 0),
hi AS (SELECT pl.l_suppkey, t, count(*) FILTER (abs(x*(a/l) - x0*(a/l) + (y*(b/l) - y0*(b/l)) + (z*(c/l) - z0*(c/l))) <= 0.002 * e) AS h
  FROM pl JOIN bo USING (l_suppkey) JOIN ext USING (l_suppkey) GROUP BY ALL),
be AS (SELECT l_suppkey, arg_max(t, (h, -t)) AS t FROM hi GROUP BY 1),
inn AS (SELECT l_suppkey, x, y, z FROM be JOIN pl USING (l_suppkey, t) JOIN bo USING (l_suppkey) JOIN ext USING (l_suppkey)
  WHERE abs(x*(a/l) - x0*(a/l) + (y*(b/l) - y0*(b/l)) + (z*(c/l) - z0*(c/l))) <= 0.002 * e),
cv AS (SELECT l_suppkey, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz,
  covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM inn GROUP BY 1),
ev AS (SELECT *, (xx + yy + zz) / 3 AS q, xx*yy + yy*zz + zz*xx - xy*xy - xz*xz - yz*yz AS k2,
  xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS k3 FROM cv),
lm AS (SELECT *, q + 2*sqrt(greatest(q*q - k2/3, 0))*cos((acos(greatest(-1, least(1, (2*q*q*q - q*k2 + k3) / (2*pow(greatest(q*q - k2/3, 1e-300), 1.5)))))
  + 2*pi()) / 3) AS lam FROM ev),
cs AS (SELECT *, [xy*yz - xz*(yy-lam), xz*xy - (xx-lam)*yz, (xx-lam)*(yy-lam) - xy*xy] AS u,
  [xy*(zz-lam) - xz*yz, xz*xz - (xx-lam)*(zz-lam), (xx-lam)*yz - xy*xz] AS v, [(yy-lam)*(zz-lam) - yz*yz, yz*xz - xy*(zz-lam), xy*yz - (yy-lam)*xz] AS w FROM lm),
ax AS (SELECT l_suppkey, mx, my, mz, CASE WHEN list_inner_product(u, u) >= list_inner_product(v, v) AND list_inner_product(u, u) >= list_inner_product(w, w) THEN u
  WHEN list_inner_product(v, v) >= list_inner_product(w, w) THEN v ELSE w END AS n FROM cs),
fi AS (SELECT l_suppkey, mx, my, mz, n[1] / sqrt(list_inner_product(n, n)) AS na, n[2] / sqrt(list_inner_product(n, n)) AS nb,
  n[3] / sqrt(list_inner_product(n, n)) AS nc FROM ax),
rs AS (SELECT l_suppkey, quantile_cont(abs((x-mx)*na + (y-my)*nb + (z-mz)*nc), 0.5) AS m FROM bo JOIN fi USING (l_suppkey) GROUP BY 1)
SELECT a.l_suppkey, count(*) FILTER (fi.na IS NULL OR abs((x-mx)*na + (y-my)*nb + (z-mz)*nc) > greatest(3 * m, 0.0025 * e)) AS n_left
FROM a JOIN ext USING (l_suppkey) LEFT JOIN fi USING (l_suppkey) LEFT JOIN rs USING (l_suppkey) GROUP BY a.l_suppkey""")
def support_plane_removal(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.xxhash64("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").alias("point_idx"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"), (F.col("l_linestatus") == "F").alias("border"))
    left = CL.remove_plane(line, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    # a cloud that lies in its plane is left with nothing, which is a result
    return line.select("l_suppkey").distinct().join(left, "l_suppkey", "left").select("l_suppkey", F.coalesce("n", F.lit(0)).alias("n_left"))


def nation_clouds(spark, sf_dir):
    """Line items of one nation's suppliers as a cloud in its unit frame."""
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    line = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.xxhash64("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").alias("point_idx"),
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
    both = line.join(supp, "l_suppkey").join(nat, "nation").drop("l_suppkey")
    return P.normalize(both, ["region", "nation"])


@query("cloud_registration")
def cloud_registration(spark, sf_dir):
    clouds = cut_lineage(nation_clouds(spark, sf_dir))
    first = clouds.groupBy("region").agg(F.min("nation").alias("nation"))
    target = clouds.join(first, ["region", "nation"], "left_semi")
    targets = cut_lineage(R.build_targets(target, ["region"], 0.15))
    _, pick = R.register(clouds, target, targets, ["region", "nation"], ["region"], 0.15, 2, 0)
    return rounded(pick.select("region", "nation", "pose_idx", "fitness", "reg_res", "n_hyp"), "fitness", "reg_res")


@query("tolerance_field")
def tolerance_field(spark, sf_dir):
    frames = nation_clouds(spark, sf_dir).withColumn("obj", F.col("nation").cast("long"))
    f = T.build_tolerance(frames, ["region"], "obj", 0.1)
    names = [c for c in f.scalars.columns if c not in ("region", "n_surface")]
    return rounded(f.scalars, *names)


@query("rigid_fit_recovery", f"""
WITH {EVENT_POINTS}, n AS (SELECT user_id FROM pt GROUP BY 1 HAVING count(*) >= 50),
m AS (SELECT user_id, ({_h01("'0'", "user_id", "'turn'")} - 0.5) * 0.02 AS a, ({_h01("'0'", "user_id", "'x'")} - 0.5) * 0.01 AS x,
  ({_h01("'0'", "user_id", "'y'")} - 0.5) * 0.01 AS y, ({_h01("'0'", "user_id", "'z'")} - 0.5) * 0.01 AS z FROM n),
p AS (SELECT user_id, unnest(range(12)) AS place, unnest([cos(a), sin(a), 0, -(cos(a)*x + sin(a)*y), -sin(a), cos(a), 0, sin(a)*x - cos(a)*y, 0, 0, 1, -z]) AS v FROM m)
SELECT user_id, place::INTEGER AS place, round(v, 4) + 0.0 AS value, 1.0::DOUBLE AS fitness, 0.0::DOUBLE AS rmse FROM p""")
def rigid_fit_recovery(spark, sf_dir):
    """Every cloud is moved by a drawn rotation and shift and fitted back to itself in rounds: the pose is the inverse motion."""
    cloud = unit_event_clouds(spark, sf_dir)
    cloud = cut_lineage(cloud.join(cloud.groupBy("user_id").count().where("count >= 50").select("user_id"), "user_id"))
    drawn = lambda t: hash01(F.lit("0"), F.col("user_id"), F.lit(t)) - 0.5
    a = drawn("turn") * 0.02
    x, y, z = (F.col(c) for c in P.XYZ)
    moved = cloud.withColumns({"x": F.cos(a) * x - F.sin(a) * y + drawn("x") * 0.01, "y": F.sin(a) * x + F.cos(a) * y + drawn("y") * 0.01,
                               "z": z + drawn("z") * 0.01})
    fits = RG.fit_to_planes(moved, cut_lineage(normals(cloud, ["user_id"], 10)), ["user_id"], ["user_id"], 0.05, 30, whole=0)
    entry = fits.select("user_id", F.posexplode("pose").alias("place", "v"), "fitness", "rmse").where("place < 12")
    return entry.select("user_id", "place", (F.round("v", 4) + 0.0).alias("value"), F.round("fitness", 4).alias("fitness"),
                        F.round("rmse", 4).alias("rmse"))


_KEPT = "region, nation, pid, n, x, y, z, gx, gy, gz, xx, xy, xz, yy, yz, zz"
_D2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"


@query("prototype_tolerance", f"""
WITH ln AS (SELECT n_regionkey AS region, n_nationkey AS nation, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
mn AS (SELECT region, nation, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ln GROUP BY ALL),
sc AS (SELECT region, nation, max(sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz))) AS sc FROM ln JOIN mn USING (region, nation) GROUP BY ALL),
u AS (SELECT region, nation, (x-mx)/sc AS x, (y-my)/sc AS y, (z-mz)/sc AS z FROM ln JOIN mn USING (region, nation) JOIN sc USING (region, nation)),
lo AS (SELECT region, nation, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM u GROUP BY ALL),
ce AS (SELECT region, nation, floor((x - (lx - 0.1)) / 0.2)::BIGINT AS i, floor((y - (ly - 0.1)) / 0.2)::BIGINT AS j, floor((z - (lz - 0.1)) / 0.2)::BIGINT AS k,
  avg(x) AS x, avg(y) AS y, avg(z) AS z FROM u JOIN lo USING (region, nation) GROUP BY ALL),
v AS (SELECT region, nation, row_number() OVER (ORDER BY region, nation, i, j, k) AS pid, x, y, z FROM ce),
pw AS (SELECT a.region, a.nation, b.nation AS other, a.pid AS p, b.pid AS q, {_D2} AS d2 FROM v a JOIN v b USING (region)),
nn AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS rn FROM pw WHERE nation = other),
g AS (SELECT region, nation, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM v GROUP BY ALL),
cv AS (SELECT region, nation, p AS pid, count(*) AS n, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z, any_value(gx) AS gx, any_value(gy) AS gy,
  any_value(gz) AS gz, covar_pop(b.x-a.x, b.x-a.x) AS xx, covar_pop(b.x-a.x, b.y-a.y) AS xy, covar_pop(b.x-a.x, b.z-a.z) AS xz,
  covar_pop(b.y-a.y, b.y-a.y) AS yy, covar_pop(b.y-a.y, b.z-a.z) AS yz, covar_pop(b.z-a.z, b.z-a.z) AS zz
  FROM nn JOIN (SELECT pid AS p, x, y, z FROM v) a USING (p) JOIN (SELECT pid AS q, x, y, z FROM v) b USING (q) JOIN g USING (region, nation)
  WHERE rn <= 20 AND sqrt(d2) <= 0.8 GROUP BY ALL),
{_normals("cv", _KEPT, "nx*(x-gx) + ny*(y-gy) + nz*(z-gz)")},
sp AS (SELECT region, nation AS other, greatest(quantile_cont(sqrt(d2), 0.5), 0.2) AS spacing FROM nn WHERE rn = 2 GROUP BY ALL),
ot AS (SELECT region, other, p, arg_min(q, (d2, q)) AS q FROM pw WHERE nation <> other GROUP BY ALL),
od AS (SELECT ot.region, ot.p, spacing, abs((a.x-b.x)*b.nx + (a.y-b.y)*b.ny + (a.z-b.z)*b.nz) AS off, {_D2} AS d2
  FROM ot JOIN o a ON a.pid = ot.p JOIN o b ON b.pid = ot.q JOIN sp ON sp.region = ot.region AND sp.other = ot.other),
lo2 AS (SELECT p, min(off + greatest(sqrt(greatest(d2 - off*off, 0)) - spacing, 0)) AS loo FROM od GROUP BY 1),
su AS (SELECT v.*, coalesce(loo, 0) AS loo FROM v LEFT JOIN lo2 ON p = pid),
ar AS (SELECT p, q, d2, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS rn FROM pw),
sg AS (SELECT ar.p AS pid, avg(loo) AS sigma FROM ar JOIN su ON su.pid = ar.q WHERE rn <= 16 GROUP BY 1),
al AS (SELECT region, nation, loo, sigma, pid FROM su JOIN sg USING (pid)),
ws AS (SELECT region, greatest(quantile_cont(d, 0.5), 0.2) AS spacing FROM (SELECT region, ar.p, min(sqrt(d2)) AS d FROM ar JOIN v ON v.pid = ar.p WHERE rn = 2 GROUP BY ALL) GROUP BY 1),
st AS (SELECT region, count(DISTINCT nation) AS k, avg(loo) AS m, quantile_cont(sigma, 0.5) AS s50, quantile_cont(sigma, 0.9) AS s90, count(*) AS n FROM al GROUP BY 1),
ep AS (SELECT st.*, spacing, CASE WHEN k > 1 AND s50 > 0 THEN s50 ELSE 0.2 END AS eps, CASE WHEN k > 1 AND m > 0 THEN m ELSE spacing END AS uniform FROM st JOIN ws USING (region)),
uu AS (SELECT region, loo / (sigma + eps) AS u FROM al JOIN ep USING (region)),
ur AS (SELECT region, avg(u) AS u_mean, stddev_pop(u) AS u_std, quantile_cont(u, 0.99) AS u_p99 FROM uu GROUP BY 1)
SELECT region, n AS n_surface, round(spacing, 5) AS spacing, round(s50, 5) AS sigma_median, round(s90, 5) AS sigma_p90, round(eps, 5) AS eps, round(uniform, 5) AS uniform,
  round(u_mean, 5) AS u_mean, round(u_std, 5) AS u_std, round(u_p99, 5) AS u_p99 FROM ep JOIN ur USING (region)""")
def prototype_tolerance(spark, sf_dir):
    """Tolerance of every region from its nations' clouds as they stand, without a fine motion between them."""
    frames = nation_clouds(spark, sf_dir).withColumn("obj", F.col("nation").cast("long"))
    f = T.build_tolerance(frames, ["region"], "obj", 0.2, refine_frames=False)
    names = ["spacing", "sigma_median", "sigma_p90", "eps", "uniform", "u_mean", "u_std", "u_p99"]
    return f.scalars.select("region", "n_surface", *[F.round(c, 5).alias(c) for c in names])


@query("anomaly_benchmark")
def anomaly_benchmark(spark, sf_dir):
    """Suppliers in good standing train the memory, the others are tested; category is the line status."""
    from ..config import Config
    from ..plans.benchmark import results_table, run_benchmark
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("category"), "l_suppkey",
        F.xxhash64("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice").alias("point_idx"),
        (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"),
        (F.col("l_discount") * 10).alias("z"), (F.col("l_returnflag") == "R").cast("float").alias("gt"))
    both = line.join(supp, "l_suppkey").withColumn("cloud_id", F.format_string("s%06d", F.col("l_suppkey")))
    train = both.where("s_acctbal >= 4000").withColumn("cloud_rank", F.col("l_suppkey") + 1)
    test = both.where("s_acctbal < 4000").withColumn("label", (F.col("s_acctbal") < 0).cast("int")).withColumn("path", F.col("cloud_id"))
    cfg = Config(max_nn=10, n_scales=2, num_group=16, group_size=8, smooth_k=4, coreset_ratio=0.05, voxel=0.02)
    run = run_benchmark(train, test, cfg)
    names = ["n_test", "n_anom", "o_auroc", "o_aupr", "p_auroc", "p_aupr", "p_auroc_pooled", "p_aupr_pooled"]
    return rounded(results_table(run.metrics, names), *names)


@query("alignment_distances", f"""
WITH {EVENT_POINTS},
pr AS (SELECT a.user_id, a.pid AS q, b.pid AS r, a.event_type AS qt, b.event_type AS rt,
  sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM pt a JOIN pt b ON a.user_id = b.user_id),
f AS (SELECT user_id, q, min(d) AS d FROM pr WHERE qt = 'error' AND rt <> 'error' GROUP BY ALL),
v AS (SELECT user_id, r, min(d) AS d FROM pr WHERE qt = 'error' AND rt <> 'error' GROUP BY ALL),
l AS (SELECT user_id, qt, q, min(d) AS d FROM pr WHERE qt <> 'error' AND rt <> 'error' AND qt <> rt GROUP BY ALL),
lo AS (SELECT user_id, avg(m) AS loo_med, avg(p) AS loo_p90 FROM (
  SELECT user_id, qt, quantile_cont(d, 0.5) AS m, quantile_cont(d, 0.9) AS p FROM l GROUP BY ALL) GROUP BY user_id),
ff AS (SELECT user_id, quantile_cont(d, 0.5) AS res_med, quantile_cont(d, 0.9) AS res_p90, quantile_cont(d, 0.99) AS res_p99 FROM f GROUP BY 1),
vv AS (SELECT user_id, quantile_cont(d, 0.9) AS rev_p90 FROM v GROUP BY 1)
SELECT user_id, round(res_med, 5) AS res_med, round(res_p90, 5) AS res_p90, round(res_p99, 5) AS res_p99, round(rev_p90, 5) AS rev_p90,
  round(loo_med, 5) AS loo_med, round(loo_p90, 5) AS loo_p90 FROM ff JOIN vv USING (user_id) LEFT JOIN lo USING (user_id)""")
def alignment_distances(spark, sf_dir):
    """Error events as a cloud on the surface of the others, whose event types are its prototypes."""
    p = cut_lineage(event_points(spark, sf_dir))
    cloud, surface = p.where("event_type = 'error'").withColumn("cloud", F.lit(0)), p.where("event_type <> 'error'")
    forward = DG.distance_shares(cloud, surface, ["user_id"], DG.SHARES, "pid", "pid")
    back = DG.reverse_shares(surface, cloud, ["user_id"], "cloud", {"rev_p90": 0.9}, "pid", "pid").drop("cloud")
    spread_ = DG.leave_one_out(surface, ["user_id"], "event_type", "pid")
    out = forward.join(back, "user_id").join(spread_, "user_id", "left")
    return out.select("user_id", *[F.round(c, 5).alias(c) for c in (*DG.SHARES, "rev_p90", "loo_med", "loo_p90")])


@query("diagnostic_medians", """
WITH l AS (SELECT l_returnflag, unnest([l_quantity, l_extendedprice, l_discount]) AS v, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric
  FROM lineitem)
SELECT l_returnflag, metric, round(quantile_cont(v, 0.5), 6) AS median FROM l GROUP BY ALL""")
def diagnostic_medians(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    return rounded(DG.diagnostic_summary(rows, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"]), "median")
