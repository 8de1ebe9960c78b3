"""Experiment analytics: customers are test samples, market segments categories, regions datasets.

A sample is anomalous when its account is overdrawn; its orders are its points. Three channels are
computed per seed from the orders and a hashed perturbation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pooling
from ..functions.expr import hash01
from ..plans import analytics as A
from ..plans import selection as S
from ..plans.bootstrap import MIX, STEPS
from .detection import ap_sql, auroc_sql
from .registry import query, r6, rounded, table

SEEDS = (0, 1, 2)
SCORES = """
base AS (SELECT r_name AS dataset, c_mktsegment AS category, c_custkey AS file, (c_acctbal < 0)::INT AS label,
  c_acctbal AS bal, count(*) AS n_points, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_anom_points,
  avg(o_totalprice) AS ap, max(o_totalprice) AS mp FROM customer JOIN orders ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
sd AS (SELECT * FROM (VALUES (0), (1), (2)) t(seed)),
hs AS (SELECT base.*, seed, ('0x' || substr(md5(seed || '|' || file || '|a'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS ha,
  ('0x' || substr(md5(seed || '|' || file || '|b'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS hb FROM base, sd),
sc AS (SELECT dataset, seed, category, file, label, n_points, n_anom_points, 'a' AS channel,
         ap * (1 + 0.3::DOUBLE * ha) - 10 * bal AS score FROM hs
  UNION ALL SELECT dataset, seed, category, file, label, n_points, n_anom_points, 'b', mp * (1 + 0.3::DOUBLE * hb) - 5 * bal FROM hs
  UNION ALL SELECT dataset, seed, category, file, label, n_points, n_anom_points, 'c', n_points::DOUBLE FROM hs)"""


def samples(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("o_orderstatus") == "F").alias("n_anom_points"),
        F.avg("o_totalprice").alias("ap"), F.max("o_totalprice").alias("mp"))
    where = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("dataset"))
    return c.join(per, "c_custkey").join(where, "c_nationkey").select(
        "dataset", F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("file"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("label"), "n_points", "n_anom_points",
        F.col("c_acctbal").alias("bal"), "ap", "mp")


def sample_scores(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("seed", F.explode(F.array(*[F.lit(x) for x in SEEDS])))
    a = F.col("ap") * (1 + 0.3 * hash01("seed", "file", F.lit("a"))) - 10 * F.col("bal")
    b = F.col("mp") * (1 + 0.3 * hash01("seed", "file", F.lit("b"))) - 5 * F.col("bal")
    each = F.array(*[F.struct(F.lit(n).alias("channel"), e.alias("score"))
                     for n, e in (("a", a), ("b", b), ("c", F.col("n_points").cast("double")))])
    return s.withColumn("_c", F.explode(each)).select(
        "dataset", "seed", "category", "file", "label", "n_points", "n_anom_points", "_c.channel", "_c.score")


PER = f"per AS ({auroc_sql('sc', 'seed, category, channel', 'label', 'score')})"


@query("seed_table", f"""
WITH {SCORES}, {PER}, m AS (SELECT channel, seed, 100 * avg(auroc) AS v FROM per GROUP BY ALL)
SELECT channel, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std_sample, round(stddev_pop(v), 6) AS std_population,
  count(*) AS n_seeds, round(max(v) FILTER (WHERE seed = 0), 6) AS seed0, round(max(v) FILTER (WHERE seed = 1), 6) AS seed1,
  round(max(v) FILTER (WHERE seed = 2), 6) AS seed2 FROM m GROUP BY channel""")
def seed_table(spark, sf_dir):
    each, summary = A.seed_table(sample_scores(spark, sf_dir))
    wide = each.groupBy("channel").pivot("seed", list(SEEDS)).agg(F.first("auroc"))
    wide = wide.select("channel", *[F.col(f"`{s}`").alias(f"seed{s}") for s in SEEDS])
    return rounded(summary.join(wide, "channel"), "mean", "std_sample", "std_population", *[f"seed{s}" for s in SEEDS])


@query("category_seed_report", f"""
WITH {SCORES}, {PER} SELECT seed, channel, category, round(auroc, 6) AS auroc FROM per
UNION ALL SELECT seed, channel, '__mean__', round(avg(auroc), 6) FROM per GROUP BY seed, channel""")
def category_seed_report(spark, sf_dir):
    return rounded(A.category_report(sample_scores(spark, sf_dir)), "auroc")


B = 2000


def _mixed_sql(src: str, h: str, kept: str) -> str:
    """Subquery with the 32-bit number ``h`` of ``src`` mixed, as ``v``."""
    return f"""(SELECT {kept}, xor(d, d // 65536) AS v FROM (SELECT *, (c * {MIX[1]}) % 4294967296 AS d FROM (SELECT *, xor(b2, b2 // 8192) AS c
    FROM (SELECT *, (a2 * {MIX[0]}) % 4294967296 AS b2 FROM (SELECT *, xor(h0, h0 // 65536) AS a2 FROM (SELECT *, (({h}) % 4294967296)::UBIGINT AS h0 FROM {src}))))))"""


def draws_sql(strata: str, kept: str, text: str) -> str:
    """Subquery (kept, b, idx): the position of every draw of every replicate of strata of up to one part (kept, n)."""
    base = f"(SELECT *, ('0x' || substr(md5('0|' || {text}), 1, 8))::UBIGINT AS h FROM {strata}, range(1, {B + 1}) t(b))"
    first = _mixed_sql(base, f"h + b::UBIGINT * {STEPS['b']}", f"{kept}, n, b")
    each = f"(SELECT *, unnest(range(n)) AS i FROM {first})"
    return f"(SELECT {kept}, b, floor(v / 4294967296.0::DOUBLE * n)::BIGINT AS idx FROM {_mixed_sql(each, 'v::UBIGINT + i::UBIGINT * %d' % STEPS['draw'], f'{kept}, n, b')})"


BOOT = f"""
mem AS (SELECT category, label, file, row_number() OVER (PARTITION BY category, label ORDER BY md5(file::VARCHAR), file) - 1 AS idx,
  count(*) OVER (PARTITION BY category, label) AS n FROM (SELECT DISTINCT category, label, file FROM sc)),
stz AS (SELECT DISTINCT category, label, n FROM mem),
drw AS (SELECT * FROM {draws_sql("stz", "category, label", "category || '|' || label")}),
bs AS (SELECT b, seed, category, channel, label, score FROM drw JOIN mem USING (category, label, idx) JOIN sc USING (category, label, file)),
ba AS ({auroc_sql('bs', 'b, seed, category, channel', 'label', 'score')})"""


@query("bootstrap_interval", f"""
WITH {SCORES}, {PER}, {BOOT},
pc AS (SELECT b, channel, 100 * avg(m) AS m FROM (SELECT b, channel, category, avg(auroc) AS m FROM ba GROUP BY ALL) GROUP BY ALL),
pt AS (SELECT channel, avg(v) AS e FROM (SELECT channel, seed, 100 * avg(auroc) AS v FROM per GROUP BY ALL) GROUP BY ALL),
d AS (SELECT b, max(m) FILTER (WHERE channel = 'a') - max(m) FILTER (WHERE channel = 'b') AS d FROM pc GROUP BY b),
de AS (SELECT max(e) FILTER (WHERE channel = 'a') - max(e) FILTER (WHERE channel = 'b') AS e FROM pt)
SELECT channel, round(max(e), 6) AS estimate, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi,
  NULL::DOUBLE AS p FROM pc JOIN pt USING (channel) GROUP BY channel
UNION ALL SELECT 'a - b', round(max(e), 6), round(quantile_cont(d, 0.025), 6), round(quantile_cont(d, 0.975), 6),
  round(CASE WHEN max(e) > 0 THEN avg((d <= 0)::INT) ELSE avg((d >= 0)::INT) END, 6) FROM d, de""")
def bootstrap_interval(spark, sf_dir):
    return rounded(A.bootstrap_summary(sample_scores(spark, sf_dir), "a", "b", B), "estimate", "lo", "hi", "p")


@query("category_differences", f"""
WITH {SCORES}, {PER}, {BOOT},
d AS (SELECT b, category, 100 * (avg(auroc) FILTER (WHERE channel = 'a') - avg(auroc) FILTER (WHERE channel = 'b')) AS d FROM ba GROUP BY ALL),
pt AS (SELECT category, 100 * avg(auroc) FILTER (WHERE channel = 'a') AS a, 100 * avg(auroc) FILTER (WHERE channel = 'b') AS b FROM per GROUP BY ALL),
n AS (SELECT category, count(*) FILTER (WHERE label = 0) AS n_normal, count(*) FILTER (WHERE label = 1) AS n_anomalous FROM mem GROUP BY ALL),
c AS (SELECT category, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM d GROUP BY ALL)
SELECT category, n_normal, n_anomalous, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi
FROM n JOIN pt USING (category) JOIN c USING (category)""")
def category_differences(spark, sf_dir):
    return rounded(A.category_differences(sample_scores(spark, sf_dir), "a", "b", B), "a", "b", "diff", "lo", "hi")


@query("ranked_differences", f"""
WITH {SCORES}, {PER},
c AS (SELECT category, 100 * avg(auroc) FILTER (WHERE channel = 'a') - 100 * avg(auroc) FILTER (WHERE channel = 'b') AS diff FROM per GROUP BY ALL)
SELECT category, round(diff, 6) AS diff, row_number() OVER (ORDER BY diff DESC NULLS LAST, category)::INTEGER AS place FROM c""")
def ranked_differences(spark, sf_dir):
    per = A.auroc_by(sample_scores(spark, sf_dir).where(F.col("channel").isin("a", "b")), ["seed", "category", "channel"])
    only = lambda c: F.avg(F.when(F.col("channel") == c, F.col("auroc"))) * 100
    d = per.groupBy("category").agg((only("a") - only("b")).alias("diff"))
    return rounded(A.ranked_differences(d), "diff")


@query("metric_choice", """
WITH m AS (UNPIVOT (SELECT l_returnflag AS category, avg(l_quantity) AS o_auroc, avg(l_tax) AS p_auroc, avg(l_discount) AS p_aupr,
  avg(l_extendedprice) AS n_test FROM lineitem GROUP BY 1) ON o_auroc, p_auroc, p_aupr, n_test INTO NAME metric VALUE value)
SELECT category, metric, round(value, 6) AS value FROM m WHERE regexp_full_match(metric, '[op]_au(roc|pr)')""")
def metric_choice(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(
        F.avg("l_quantity").alias("o_auroc"), F.avg("l_tax").alias("p_auroc"), F.avg("l_discount").alias("p_aupr"),
        F.avg("l_extendedprice").alias("n_test"))
    long = means.unpivot("category", ["o_auroc", "p_auroc", "p_aupr", "n_test"], "metric", "value")
    return rounded(A.choose_metrics(long, "[op]_au(roc|pr)"), "value")


@query("operating_points", f"""
WITH {SCORES}, o AS ({ap_sql('sc', 'seed, category, channel', 'label', 'score')})
SELECT channel, round(100 * avg(fpr_at_95tpr), 6) AS fpr_at_95tpr, round(100 * avg(tpr_at_5fpr), 6) AS tpr_at_5fpr FROM o GROUP BY channel""")
def operating_points(spark, sf_dir):
    return rounded(A.operating_points(sample_scores(spark, sf_dir)), "fpr_at_95tpr", "tpr_at_5fpr")


@query("defect_size_strata", f"""
WITH {SCORES}, f AS (SELECT *, n_anom_points / greatest(n_points, 1)::DOUBLE AS frac FROM sc),
q AS (SELECT quantile_cont(frac, {1 / 3}) AS q1, quantile_cont(frac, {2 / 3}) AS q2
  FROM (SELECT DISTINCT seed, category, file, frac FROM f WHERE label = 1)),
t AS (SELECT f.*, s.stratum FROM f, q, (VALUES ('small'), ('medium'), ('large')) s(stratum)
  WHERE label = 0 OR s.stratum = CASE WHEN frac < q1 THEN 'small' WHEN frac < q2 THEN 'medium' ELSE 'large' END),
a AS ({auroc_sql('t', 'seed, category, channel, stratum', 'label', 'score')})
SELECT channel, stratum, round(100 * avg(auroc), 6) AS auroc FROM a GROUP BY ALL""")
def defect_size_strata(spark, sf_dir):
    return rounded(A.size_strata(sample_scores(spark, sf_dir)), "auroc")


@query("rule_comparison", f"""
WITH r AS (SELECT l_linestatus AS category, l_suppkey, l_extendedprice AS v,
    row_number() OVER (PARTITION BY l_linestatus, l_suppkey ORDER BY l_extendedprice DESC) AS rn,
    count(*) OVER (PARTITION BY l_linestatus, l_suppkey) AS n FROM lineitem),
p AS (SELECT category, l_suppkey, max(v) AS "max", avg(v) AS mean, avg(v) FILTER (WHERE rn <= 10) AS top10,
    avg(v) FILTER (WHERE rn <= greatest(1, round_even(0.01 * n, 0))) AS top1pct, quantile_cont(v, 0.95) AS p95 FROM r GROUP BY ALL),
l AS (SELECT category, rule, score, (s_acctbal < 0)::INT AS label FROM (UNPIVOT p ON "max", mean, top10, top1pct, p95 INTO NAME rule VALUE score)
  JOIN supplier ON s_suppkey = l_suppkey),
a AS ({auroc_sql('l', 'rule, category', 'label', 'score')})
SELECT rule, category, round(auroc, 6) AS auroc FROM a UNION ALL SELECT rule, '__mean__', round(avg(auroc), 6) FROM a GROUP BY rule""")
def rule_comparison(spark, sf_dir):
    rules = ["max", "mean", "top10", "top1pct", "p95"]
    pts = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("category"), "l_suppkey", F.col("l_extendedprice").alias("score"))
    stats = pooling.object_scores(pts, ["category", "l_suppkey"], "score", rules)
    supp = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("label"))
    s = stats.join(supp, "l_suppkey").drop("l_suppkey")
    return rounded(A.rule_comparison(s, ["category"], "label", rules), "auroc")


def _fusion_sql(norm: str) -> str:
    return f"""
WITH {SCORES},
rf AS (SELECT seed, category, channel, avg(score) AS mean, stddev_samp(score) AS std, quantile_cont(score, 0.99) AS p99
  FROM sc WHERE label = 0 GROUP BY ALL),
nr AS (SELECT sc.seed, sc.category, sc.file, sc.label, sc.channel, {norm} AS score FROM sc JOIN rf USING (seed, category, channel)),
w AS (SELECT seed, category, file, label, max(score) FILTER (WHERE channel = 'a') AS a, max(score) FILTER (WHERE channel = 'b') AS b,
  max(score) FILTER (WHERE channel = 'c') AS c FROM nr GROUP BY ALL),
l AS (SELECT seed, category, label, 'a' AS combo, a AS score FROM w UNION ALL SELECT seed, category, label, 'b', b FROM w
  UNION ALL SELECT seed, category, label, 'c', c FROM w UNION ALL SELECT seed, category, label, 'a+b', (a + b) / 2 FROM w
  UNION ALL SELECT seed, category, label, 'a+c', (a + c) / 2 FROM w UNION ALL SELECT seed, category, label, 'b+c', (b + c) / 2 FROM w
  UNION ALL SELECT seed, category, label, 'a+b+c', (a + b + c) / 3 FROM w),
x AS ({auroc_sql('l', 'seed, combo, category', 'label', 'score')})
SELECT seed, combo, category, round(auroc, 6) AS auroc FROM x
UNION ALL SELECT seed, combo, '__mean__', round(avg(auroc), 6) FROM x GROUP BY seed, combo"""


def _fusion(spark, sf_dir, how):
    from ..operators.prefix import ordered_totals, percentile_of
    s = sample_scores(spark, sf_dir)
    keys = ["seed", "category", "channel"]
    normal = s.where("label = 0")
    ref = normal.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std")).join(
        ordered_totals(normal, keys, "score").groupBy(*keys).agg(percentile_of(0.99).alias("p99")), keys)
    scaled = A.normalise_to_training(s, ref, how, keys)
    return rounded(A.subset_fusion(scaled, ["a", "b", "c"], "channel", ["seed"]), "auroc")


@query("scale_fusion_z", _fusion_sql("(score - mean) / greatest(std, 1e-12)"))
def scale_fusion_z(spark, sf_dir):
    return _fusion(spark, sf_dir, "z")


@query("scale_fusion_ratio", _fusion_sql("score / greatest(p99, 1e-12)"))
def scale_fusion_ratio(spark, sf_dir):
    return _fusion(spark, sf_dir, "ratio")


RUNS = """
mo AS (SELECT o_orderpriority AS tag, extract(year FROM o_orderdate)::INT AS seed, extract(month FROM o_orderdate)::INT AS file,
  o_totalprice AS p FROM orders),
runs AS (SELECT tag, seed, avg(p) / 1000 AS value FROM mo WHERE file = (SELECT max(file) FROM mo x WHERE x.tag = mo.tag AND x.seed = mo.seed)
  GROUP BY ALL)"""


def run_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("tag"), F.year("o_orderdate").alias("seed"),
        F.month("o_orderdate").alias("file"), (F.col("o_totalprice")).alias("p"))
    return A.latest_runs(o).groupBy("tag", "seed").agg((F.avg("p") / 1000).alias("value"))


@query("seed_aggregate", f"""
WITH {RUNS} SELECT tag, count(*) AS n_seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM runs GROUP BY tag""")
def seed_aggregate(spark, sf_dir):
    return rounded(A.seed_aggregate(run_values(spark, sf_dir)), "mean", "std")


@query("paired_delta", f"""
WITH {RUNS}, d AS (SELECT a.tag, a.value - b.value AS d FROM runs a JOIN runs b USING (seed) WHERE b.tag = '1-URGENT' AND a.tag <> '1-URGENT')
SELECT tag, count(*) AS n_common, round(avg(d), 6) AS delta, round(stddev_samp(d), 6) AS std,
  count(*) >= 3 AND abs(avg(d)) < 2 * stddev_samp(d) AS noise FROM d GROUP BY tag""")
def paired_delta(spark, sf_dir):
    return rounded(A.paired_delta(run_values(spark, sf_dir), "1-URGENT"), "delta", "std")


@query("run_gates", f"""
WITH {RUNS}, m AS (SELECT tag, avg(value) AS mean, count(*) AS n FROM runs GROUP BY tag)
SELECT tag, n, round(mean, 6) AS mean, round(mean - b, 6) AS diff, CASE WHEN mean - b >= 0 THEN 'PASS' ELSE 'FAIL' END AS gate
FROM m, (SELECT avg(value) AS b FROM runs WHERE tag = '5-LOW')""")
def run_gates(spark, sf_dir):
    return rounded(A.gate(run_values(spark, sf_dir), "5-LOW", 0.0), "mean", "diff")


@query("merged_parts", """
WITH v AS (SELECT n_nationkey AS ord, n_name AS category, avg(c_acctbal) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT ord, category, round(value, 6) AS value FROM v UNION ALL SELECT max(ord) + 1, '__mean__', round(avg(value), 6) FROM v""")
def merged_parts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    cats = n.select(F.col("n_name").alias("category"), F.col("n_nationkey").alias("ord"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("category"), F.col("n_regionkey").alias("part")).agg(F.avg("c_acctbal").alias("value"))
    return rounded(A.merge_parts(c, cats, ["value"]), "value")


@query("last_record_wins", """
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def last_record_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.last_record_wins(e, ["user_id", "event_type"], F.struct("ts", "event_id"), ["value"])


@query("record_keys", """
WITH d AS (SELECT conv_id, count(*) <> count(DISTINCT role) AS dup FROM conversations GROUP BY 1)
SELECT conv_id, turn, CASE WHEN dup THEN format('{:05d}|{}', turn, role) ELSE role END AS key FROM conversations JOIN d USING (conv_id)""")
def record_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return A.keyed(c, ["conv_id"], "turn", "role").select("conv_id", "turn", "key")


@query("log_error_lines", r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE contains(line, 'Error') OR contains(line, 'Traceback')) AS n_errors
FROM l GROUP BY source""")
def log_error_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("value"))
    return A.error_lines(d, ["source"])


@query("split_counts", """
SELECT lang AS category, source AS split, count(*) AS n_files FROM documents GROUP BY ALL""")
def split_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.col("source").alias("split"))
    return A.split_counts(d)


CONFIGS = f"""
cu AS (SELECT r_name AS dataset, c_mktsegment AS unit, c_custkey AS file, (c_acctbal < 0)::INT AS label, c_acctbal AS bal, o_totalprice AS v
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
po AS (SELECT dataset, unit, file, label, bal, max(v) AS "max", quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.95) AS p95,
  avg(v) AS mean FROM cu GROUP BY ALL),
ru AS (SELECT unnest({list(S.RULES)}) AS rule),
rec AS (SELECT dataset, unit, file, label, rule || '_' || pool AS key, (s - 10 * bal) * (1 + ('0x' || substr(md5(rule || '|' || file), 1, 8))::BIGINT
   / 4294967296.0::DOUBLE) AS score FROM (UNPIVOT po ON "max", p99, p95, mean INTO NAME pool VALUE s), ru),
ua AS ({auroc_sql('rec', 'dataset, unit, key', 'label', 'score')}),
cs AS (SELECT key, avg(m) AS mean FROM (SELECT key, dataset, 100 * avg(auroc) AS m FROM ua GROUP BY ALL) GROUP BY key)"""


def config_records(spark, sf_dir):
    base = samples(spark, sf_dir).select("dataset", F.col("category").alias("unit"), "file", "label", "bal")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_totalprice").alias("score"))
    rules = ["max", "p99", "p95", "mean"]
    pooled = pooling.object_scores(o, ["file"], "score", rules)
    long = pooled.unpivot(["file"], rules, "pool", "s").join(base, "file").withColumn(
        "rule", F.explode(F.array(*[F.lit(r) for r in S.RULES])))
    score = (F.col("s") - 10 * F.col("bal")) * (1 + hash01("rule", "file"))
    return long.select(F.lit(40).alias("k"), "dataset", "unit", "file", "label",
                       F.concat_ws("_", "rule", "pool").alias("key"), score.alias("score"))


@query("config_scores", f"WITH {CONFIGS} SELECT key, round(mean, 6) AS mean FROM cs")
def config_scores(spark, sf_dir):
    units = S.unit_values(config_records(spark, sf_dir))
    return rounded(S.config_scores(units).select("key", "mean"), "mean")


@query("config_pick", f"""
WITH {CONFIGS}, o AS (SELECT rule, row_number() OVER () AS ord FROM ru),
c AS (SELECT rule, ord, mean FROM o JOIN cs ON cs.key = o.rule || '_p99')
SELECT rule, round(mean, 6) AS mean FROM c WHERE mean >= (SELECT max(mean) FROM c) - 0.5 ORDER BY ord LIMIT 1""")
def config_pick(spark, sf_dir):
    units = S.unit_values(config_records(spark, sf_dir))
    order = F.array_position(F.array(*[F.lit(f"{r}_p99") for r in S.RULES]), F.col("key"))
    options = S.config_scores(units).withColumn("ord", order).where("ord > 0")
    best = S.pick(options.select("key", "mean", "ord"))
    return best.select(F.regexp_replace("key", "_p99$", "").alias("rule"), r6("mean"))


@query("unit_bootstrap", f"""
WITH {CONFIGS}, best AS (SELECT arg_max(key, mean) AS k FROM cs WHERE key LIKE '%\\_p99' ESCAPE '\\'),
d AS (SELECT a.key AS option, a.dataset, a.unit, a.auroc - r.auroc AS diff FROM ua a JOIN ua r USING (dataset, unit), best
  WHERE a.key LIKE '%\\_p99' ESCAPE '\\' AND r.key = best.k AND a.key <> best.k AND a.auroc - r.auroc IS NOT NULL),
mm AS (SELECT *, row_number() OVER (PARTITION BY option, dataset ORDER BY md5(unit), unit) - 1 AS idx,
  count(*) OVER (PARTITION BY option, dataset) AS n FROM d),
sz AS (SELECT DISTINCT option, dataset, n FROM mm), dr AS (SELECT * FROM {draws_sql("sz", "option, dataset", "dataset")}),
e AS (SELECT b, option, dataset, 100 * avg(diff) AS m FROM dr JOIN mm USING (option, dataset, idx) GROUP BY ALL),
g AS (SELECT b, option, avg(m) AS m FROM e GROUP BY ALL)
SELECT option, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM g GROUP BY option""")
def unit_bootstrap(spark, sf_dir):
    from ..session import cut_lineage
    units = cut_lineage(S.unit_values(config_records(spark, sf_dir)))
    return rounded(S.differences_to_best(units, [f"{r}_p99" for r in S.RULES], 40, B), "lo", "hi")


@query("seed_set_operations", f"""
WITH p AS (SELECT DISTINCT extract(year FROM o_orderdate)::INT AS seed, o_custkey FROM orders),
s AS (SELECT count(DISTINCT seed) AS n FROM p), c AS (SELECT o_custkey, count(*) AS k FROM p GROUP BY 1)
SELECT (k = n) AS in_all, count(*) AS n_categories FROM c, s GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM p)""")
def seed_set_operations(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("seed"), F.col("o_custkey").alias("category"))
    common = A.common_categories(p).select("category").distinct()
    every = p.select("category").distinct()
    inside = common.agg(F.count(F.lit(1)).alias("n_categories")).select(F.lit(True).alias("in_all"), "n_categories")
    outside = every.join(common, "category", "left_anti").agg(F.count(F.lit(1)).alias("n_categories")).select(
        F.lit(False).alias("in_all"), "n_categories")
    missing = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("category")).join(
        every, "category", "left_anti").agg(F.count(F.lit(1)).alias("n_categories")).select(
        F.lit(None).cast("boolean").alias("in_all"), "n_categories")
    return inside.unionByName(outside).unionByName(missing)


@query("map_sample_plan", """
WITH c AS (SELECT c_mktsegment AS category, c_name AS path, (c_acctbal < 0)::INT AS label FROM customer)
SELECT category, label, path FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY path) AS rn FROM c)
WHERE rn <= CASE WHEN label = 1 THEN 2 ELSE 1 END""")
def map_sample_plan(spark, sf_dir):
    from ..operators.preprocess import map_sample_plan as plan
    c = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("category"), F.col("c_name").alias("path"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("label"))
    return plan(c).select("category", "label", "path")
