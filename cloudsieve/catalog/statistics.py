"""Grouped statistics whose flavours must not be mixed up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.prefix import lower_quantile_of, ordered_totals, percentile_of
from .registry import query, r6, rounded, table


@query("percentiles_and_medians", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median_mid, quantile_disc(value, 0.5) AS median_low,
  round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99,
  round(quantile_cont(value, 1.0/3), 6) AS third
FROM events GROUP BY event_type""")
def percentiles_and_medians(spark, sf_dir):
    t = ordered_totals(table(spark, sf_dir, "events"), ["event_type"], "value")
    out = t.groupBy("event_type").agg(
        percentile_of(0.5).alias("median_mid"), lower_quantile_of(0.5).alias("median_low"),
        percentile_of(0.9).alias("p90"), percentile_of(0.99).alias("p99"), percentile_of(1.0 / 3).alias("third"))
    return rounded(out, "median_mid", "p90", "p99", "third")


@query("deviation_flavours", """
SELECT c_mktsegment, c_nationkey, round(stddev_samp(c_acctbal), 6) AS std_sample,
  round(stddev_pop(c_acctbal), 6) AS std_population, count(*) AS n FROM customer GROUP BY ALL""")
def deviation_flavours(spark, sf_dir):
    return rounded(
        table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
            F.stddev_samp("c_acctbal").alias("std_sample"), F.stddev_pop("c_acctbal").alias("std_population"),
            F.count(F.lit(1)).alias("n")),
        "std_sample", "std_population")


@query("undefined_value_policies", """
WITH a AS (SELECT l_suppkey, l_returnflag, avg(l_tax) FILTER (WHERE l_quantity > 49) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(m), 6) AS mean_skip, CASE WHEN count(*) = count(m) THEN round(avg(m), 6) END AS mean_strict,
  count(*) - count(m) AS n_undefined FROM a GROUP BY l_returnflag""")
def undefined_value_policies(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.avg(F.when(F.col("l_quantity") > 49, F.col("l_tax"))).alias("m"))
    n = F.count(F.lit(1)) - F.count("m")
    return a.groupBy("l_returnflag").agg(
        r6(F.avg("m"), "mean_skip"), r6(F.when(n == 0, F.avg("m")), "mean_strict"), n.alias("n_undefined"))


@query("vector_mean", """
SELECT label, pos - 1 AS dim, round(avg(v), 6) AS mean FROM (
  SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
GROUP BY label, pos""")
def vector_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(r6(F.avg(F.col("v").cast("double")), "mean"))


@query("median_table", """
SELECT o_orderstatus, o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS median
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))""")
def median_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    fine = ordered_totals(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice").groupBy(
        "o_orderstatus", "o_orderpriority").agg(percentile_of(0.5).alias("median"))
    coarse = ordered_totals(o, ["o_orderstatus"], "o_totalprice").groupBy("o_orderstatus").agg(
        percentile_of(0.5).alias("median")).withColumn("o_orderpriority", F.lit(None).cast("string"))
    return rounded(fine.unionByName(coarse), "median")


@query("argmin_argmax", """
SELECT l_suppkey, arg_min(k, (l_extendedprice, k)) AS cheapest, arg_max(k, (l_extendedprice, -ok, -ln)) AS dearest
FROM (SELECT *, l_orderkey AS ok, l_linenumber AS ln, l_orderkey || '-' || l_linenumber AS k FROM lineitem)
GROUP BY l_suppkey""".replace("arg_min(k, (l_extendedprice, k))", "arg_min(k, (l_extendedprice, ok, ln))"))
def argmin_argmax(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn(
        "k", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    low = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    high = F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return line.groupBy("l_suppkey").agg(F.min_by("k", low).alias("cheapest"), F.max_by("k", high).alias("dearest"))


@query("share_filter", """
WITH c AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_suppkey, n FROM (SELECT *, max(n) OVER (PARTITION BY l_returnflag) AS m FROM c) WHERE n >= 0.5 * m""")
def share_filter(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"))
    top = c.groupBy("l_returnflag").agg(F.max("n").alias("m"))
    return c.join(top, "l_returnflag").where(F.col("n") >= 0.5 * F.col("m")).drop("m")


@query("mean_of_means", """
WITH u AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY ALL),
d AS (SELECT o_orderpriority, avg(m) AS m FROM u GROUP BY ALL)
SELECT o_orderpriority, round(m, 4) AS mean FROM d UNION ALL SELECT '__overall__', round(avg(m), 4) FROM d""")
def mean_of_means(spark, sf_dir):
    u = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    d = u.groupBy("o_orderpriority").agg(F.avg("m").alias("m"))
    both = d.unionByName(d.agg(F.avg("m").alias("m")).withColumn("o_orderpriority", F.lit("__overall__")))
    return both.select("o_orderpriority", F.round("m", 4).alias("mean"))


@query("conditional_minimum", """
SELECT o_orderpriority, min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS min_f,
  min(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS min_other,
  count_if(o_totalprice > 400000) AS n_high, count(DISTINCT o_orderstatus) AS n_status
FROM orders GROUP BY o_orderpriority""")
def conditional_minimum(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.min(F.when(F.col("o_orderstatus") == "F", p)).alias("min_f"),
        F.min(F.when(F.col("o_orderstatus") != "F", p)).alias("min_other"),
        F.count_if(p > 400000).alias("n_high"), F.countDistinct("o_orderstatus").alias("n_status"))


@query("second_best_ratio", """
WITH r AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS rmse FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY rmse, l_returnflag) AS rn FROM r)
SELECT l_suppkey, max(l_returnflag) FILTER (WHERE rn = 1) AS owner,
  round(max(rmse) FILTER (WHERE rn = 2) / max(rmse) FILTER (WHERE rn = 1), 6) AS ratio FROM k GROUP BY l_suppkey""")
def second_best_ratio(spark, sf_dir):
    from ..operators.memory import assign_owner
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("rmse"))
    out = assign_owner(r, ["l_suppkey"], "l_returnflag", "rmse")
    return out.select("l_suppkey", "owner", r6("ratio"))


@query("tertile_strata", """
WITH q AS (SELECT quantile_cont(o_totalprice, 1.0/3) AS a, quantile_cont(o_totalprice, 2.0/3) AS b FROM orders)
SELECT CASE WHEN o_totalprice < a THEN 'small' WHEN o_totalprice < b THEN 'medium' ELSE 'large' END AS stratum,
  count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders, q GROUP BY 1""")
def tertile_strata(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    q = ordered_totals(o, [], "o_totalprice").agg(percentile_of(1.0 / 3).alias("a"), percentile_of(2.0 / 3).alias("b"))
    p = F.col("o_totalprice")
    name = F.when(p < F.col("a"), "small").when(p < F.col("b"), "medium").otherwise("large")
    # the cut points are a single aggregate row
    return o.join(F.broadcast(q), F.lit(True)).groupBy(name.alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"))
