"""Detection metrics and object scores over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import pooling
from ..operators.prefix import average_ranks
from .registry import query, r6, rounded, table

DOCS = """
docs AS (SELECT d.lang, d.source, d.n_chars::DOUBLE AS s, l.toxic AS toxic, l.quality AS quality
         FROM documents d JOIN labels l USING (doc_id))"""


def auroc_sql(source: str, keys: str, y: str, s: str) -> str:
    """Rank form of the AUROC, one row per key."""
    return f"""
SELECT {keys}, CASE WHEN sum({y}) > 0 AND sum(1 - {y}) > 0 THEN
    (sum(CASE WHEN {y} = 1 THEN r END) - sum({y}) * (sum({y}) + 1) / 2.0)
    / (sum({y})::DOUBLE * sum(1 - {y})) END AS auroc
FROM (SELECT {keys}, {y}, rank() OVER (PARTITION BY {keys} ORDER BY {s})
             + (count(*) OVER (PARTITION BY {keys}, {s}) - 1) / 2.0 AS r
      FROM {source} WHERE {s} IS NOT NULL) AS ranked
GROUP BY {keys}"""


def ap_sql(source: str, keys: str, y: str, s: str) -> str:
    """Average precision with tied scores as one threshold, one row per key."""
    return f"""
SELECT {keys}, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN
    sum(p * (ctp::DOUBLE / (ctp + cfp))) / max(np) END AS aupr,
    CASE WHEN max(np) > 0 AND max(nn) > 0 THEN
    coalesce(min(cfp::DOUBLE / nn) FILTER (WHERE ctp::DOUBLE / np >= 0.95), 1.0) END AS fpr_at_95tpr,
    CASE WHEN max(np) > 0 AND max(nn) > 0 THEN
    coalesce(max(ctp::DOUBLE / np) FILTER (WHERE cfp::DOUBLE / nn <= 0.05), 0.0) END AS tpr_at_5fpr
FROM (SELECT {keys}, p,
        sum(p) OVER w AS ctp, sum(n) OVER w AS cfp,
        nullif(sum(p) OVER (PARTITION BY {keys}), 0) AS np,
        nullif(sum(n) OVER (PARTITION BY {keys}), 0) AS nn
      FROM (SELECT {keys}, {s} AS v, sum({y}) AS p, sum(1 - {y}) AS n
            FROM {source} WHERE {s} IS NOT NULL GROUP BY {keys}, {s}) AS per_value
      WINDOW w AS (PARTITION BY {keys} ORDER BY v DESC ROWS UNBOUNDED PRECEDING)) AS cum
GROUP BY {keys}"""


def labelled_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query("auroc_by_category_with_mean", f"""
WITH {DOCS}, a AS ({auroc_sql('docs', 'lang', 'toxic', 's')})
SELECT lang, round(auroc, 6) AS auroc FROM a
UNION ALL SELECT '__mean__', round(avg(auroc), 6) FROM a""")
def auroc_by_category_with_mean(spark, sf_dir):
    each = M.roc_table(labelled_documents(spark, sf_dir), ["lang"], "toxic", "n_chars").groupBy("lang").agg(
        M.auroc_agg().alias("auroc"))
    return rounded(M.with_mean_row(each, "lang", ["auroc"]), "auroc")


@query("detection_metrics_by_source", f"""
WITH {DOCS}, a AS ({auroc_sql('docs', 'source', 'quality', 's')}),
b AS ({ap_sql('docs', 'source', 'quality', 's')})
SELECT a.source, round(auroc, 6) AS auroc, round(aupr, 6) AS aupr,
  round(fpr_at_95tpr, 6) AS fpr_at_95tpr, round(tpr_at_5fpr, 6) AS tpr_at_5fpr
FROM a JOIN b USING (source)""")
def detection_metrics_by_source(spark, sf_dir):
    m = M.detection_metrics(labelled_documents(spark, sf_dir), ["source"], "quality", "n_chars", True)
    return rounded(m, "auroc", "aupr", "fpr_at_95tpr", "tpr_at_5fpr")


SAMPLES = """
pts AS (SELECT l_linestatus AS category, l_suppkey AS cloud_id, l_extendedprice AS score,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS gt FROM lineitem),
smp AS (SELECT p.category, p.cloud_id, max(CASE WHEN s.s_acctbal < 0 THEN 1 ELSE 0 END) AS label,
               max(p.score) AS object_score
        FROM pts p JOIN supplier s ON s.s_suppkey = p.cloud_id GROUP BY ALL)"""


def supplier_points(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_linestatus").alias("category"), F.col("l_suppkey").alias("cloud_id"),
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("gt"))


def supplier_samples(spark, sf_dir, points):
    supp = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("cloud_id"), F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("label"))
    return points.groupBy("category", "cloud_id").agg(F.max("score").alias("object_score")).join(supp, "cloud_id")


@query("benchmark_metrics", f"""
WITH {SAMPLES},
n AS (SELECT category, count(*) AS n_test, sum(label) AS n_anom FROM smp GROUP BY category),
oa AS ({auroc_sql('smp', 'category', 'label', 'object_score')}),
op AS ({ap_sql('smp', 'category', 'label', 'object_score')}),
pa AS ({auroc_sql('pts', 'category, cloud_id', 'gt', 'score')}),
pp AS ({ap_sql('pts', 'category, cloud_id', 'gt', 'score')}),
qa AS ({auroc_sql('pts', 'category', 'gt', 'score')}),
qp AS ({ap_sql('pts', 'category', 'gt', 'score')}),
pam AS (SELECT category, avg(auroc) AS v FROM pa GROUP BY category),
ppm AS (SELECT category, avg(aupr) AS v FROM pp GROUP BY category),
m AS (SELECT n.category, n_test::DOUBLE AS n_test, n_anom::DOUBLE AS n_anom, oa.auroc AS o_auroc, op.aupr AS o_aupr,
  pam.v AS p_auroc, ppm.v AS p_aupr, qa.auroc AS p_auroc_pooled, qp.aupr AS p_aupr_pooled
FROM n JOIN oa USING (category) JOIN op USING (category) JOIN pam USING (category) JOIN ppm USING (category)
  JOIN qa USING (category) JOIN qp USING (category)),
u AS (SELECT * FROM m UNION ALL SELECT '__mean__', avg(n_test), avg(n_anom), avg(o_auroc), avg(o_aupr), avg(p_auroc), avg(p_aupr),
  avg(p_auroc_pooled), avg(p_aupr_pooled) FROM m)
SELECT category, n_test, n_anom, round(o_auroc, 6) AS o_auroc, round(o_aupr, 6) AS o_aupr,
  round(p_auroc, 6) AS p_auroc, round(p_aupr, 6) AS p_aupr,
  round(p_auroc_pooled, 6) AS p_auroc_pooled, round(p_aupr_pooled, 6) AS p_aupr_pooled FROM u""")
def benchmark_metrics(spark, sf_dir):
    points = supplier_points(spark, sf_dir)
    m = M.compute_metrics(supplier_samples(spark, sf_dir, points), points)
    names = [c for c in m.columns if c != "category"]
    return rounded(M.with_mean_row(m, "category", names), *names)


@query("object_score_stats", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(max(value), 6) AS "max", round(avg(value), 6) AS mean,
  round(avg(value) FILTER (WHERE rn <= 10), 6) AS top10, round(avg(value) FILTER (WHERE rn <= 32), 6) AS top32,
  round(avg(value) FILTER (WHERE rn <= 80), 6) AS top80, round(avg(value) FILTER (WHERE rn <= 200), 6) AS top200,
  round(avg(value) FILTER (WHERE rn <= greatest(1, round_even(0.01 * n, 0))), 6) AS top1pct,
  round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.90), 6) AS p90
FROM r GROUP BY user_id""")
def object_score_stats(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "value")
    return rounded(pooling.object_scores(ev, ["user_id"], "value"), *pooling.STATS)


@query("object_score_topk", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS rn FROM events)
SELECT event_type, round(max(value), 6) AS k1, round(avg(value) FILTER (WHERE rn <= 50), 6) AS k50,
  round(avg(value), 6) AS k0, round(quantile_cont(value, 0.975), 6) AS "p97.5" FROM r GROUP BY event_type""")
def object_score_topk(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    rules = ["max", "top50", "mean", "p97.5"]
    out = pooling.object_scores(ev, ["event_type"], "value", rules).toDF("event_type", "k1", "k50", "k0", "p97.5")
    return out.select("event_type", r6("k1"), r6("k50"), r6("k0"), r6(F.col("`p97.5`"), "p97.5"))


@query("average_ranks", """
SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
   + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS avg_rank FROM events""")
def ranks(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return average_ranks(ev, ["event_type"], "value").select("event_id", "event_type", "avg_rank")


@query("defect_fraction", """
SELECT l_suppkey AS cloud_id, count(*) AS n_points,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_anom_points,
  round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / greatest(count(*), 1)::DOUBLE, 6) AS frac
FROM lineitem GROUP BY l_suppkey""")
def defect_fraction(spark, sf_dir):
    from ..functions.expr import defect_fraction as frac
    g = supplier_points(spark, sf_dir).groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum(F.col("gt").cast("long")).alias("n_anom_points"))
    return g.withColumn("frac", r6(frac("n_anom_points", "n_points")))
