"""Inferential statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import stats
from lotwise.queries.base import ols2_sql, query, rounded, table


@query(
    """
    WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS d,
        avg(l_quantity) / stddev_pop(l_quantity) AS z1, avg(l_extendedprice) / stddev_pop(l_extendedprice) AS z2, avg(l_discount) / stddev_pop(l_discount) AS z3 FROM lineitem),
    e AS (SELECT *, 1 + 2 * a * b * d - a * a - b * b - d * d AS det FROM c)
    SELECT 'l_quantity' AS feature, round((1 - d * d) / det, 6) AS vif FROM e
    UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM e UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM e
    UNION ALL SELECT 'const', round(1 + (z1 * z1 * (1 - d * d) + z2 * z2 * (1 - b * b) + z3 * z3 * (1 - a * a)
        + 2 * z1 * z2 * (b * d - a) + 2 * z1 * z3 * (a * d - b) + 2 * z2 * z3 * (a * b - d)) / det, 6) FROM e
    """
)
def vif(spark, sf):
    return rounded(stats.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 6, "vif")


def _anova_sql(source: str, y: str, g: str) -> str:
    return f"""WITH k AS (SELECT {g} AS g, count(*) AS n, avg({y}) AS m, var_pop({y}) * count(*) AS ss FROM {source} GROUP BY 1),
    t AS (SELECT sum(n * pow(m - (SELECT sum(n * m) / sum(n) FROM k), 2)) AS ssb, sum(ss) AS ssw, count(*) - 1.0::double AS d1, sum(n) - count(*) * 1.0::double AS d2 FROM k)"""


# The tail of F(4, d) and F(2, d) in closed form; the five order priorities and three return flags need no more.
_TAIL4 = "round(pow(ssw / (ssw + ssb), d2 / 2) * (1 + d2 / 2 * ssb / (ssw + ssb)), 6)"


@query(
    _anova_sql("orders", "ln(o_totalprice)", "o_orderpriority")
    + f""" SELECT 'o_orderpriority' AS term, round(ssb, 6) AS sum_sq, d1 AS df, round((ssb / d1) / (ssw / d2), 6) AS "F", {_TAIL4} AS p FROM t
    UNION ALL SELECT 'residual', round(ssw, 6), d2, NULL, NULL FROM t"""
)
def anova_one_way(spark, sf):
    rows = table(spark, sf, "orders").select(F.ln("o_totalprice").alias("y"), "o_orderpriority")
    return rounded(stats.anova_one_way(rows, "y", "o_orderpriority"), 6, "sum_sq", "F", "p")


@query(
    _anova_sql(
        """(SELECT o_orderpriority AS p, abs(ln(o_totalprice) - md) AS z FROM orders
            JOIN (SELECT o_orderpriority AS q, quantile_cont(ln(o_totalprice), 0.5) AS md FROM orders GROUP BY 1) ON o_orderpriority = q)""",
        "z", "p",
    )
    + f""" SELECT round((ssb / d1) / (ssw / d2), 6) AS "W", {_TAIL4} AS p, d1 AS df1, d2 AS df2 FROM t"""
)
def levene(spark, sf):
    rows = table(spark, sf, "orders").select(F.ln("o_totalprice").alias("y"), "o_orderpriority")
    return rounded(stats.levene(rows, "y", "o_orderpriority"), 6, "W", "p")


# With two levels in the second factor the additive fit has a closed form.
_TWO_WAY = """
    WITH k AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
    ra AS (SELECT a, sum(n) AS n, sum(n * m) / sum(n) AS m FROM k GROUP BY 1), rb AS (SELECT b, sum(n * m) / sum(n) AS m FROM k GROUP BY 1),
    w AS (SELECT sum(ss) AS ssw, sum(n) AS n, count(*) AS cells FROM k),
    sa AS (SELECT sum(k.n * pow(k.m - ra.m, 2)) AS v FROM k JOIN ra USING (a)), sb AS (SELECT sum(k.n * pow(k.m - rb.m, 2)) AS v FROM k JOIN rb USING (b)),
    d AS (SELECT f.n * o.n / (f.n + o.n) AS h, f.m - o.m AS gap FROM k f JOIN k o ON f.a = o.a AND f.b = 'F' AND o.b = 'O'),
    x AS (SELECT pow(sum(h * gap), 2) / sum(h) AS ssb_a FROM d),
    z AS (SELECT ssw + sa.v - ssb_a AS additive, ssw + sb.v AS only_b, ssb_a, ssw, n, cells, (SELECT count(*) FROM ra) AS la FROM w, sa, sb, x)"""


@query(
    _TWO_WAY
    + """ SELECT 'l_returnflag' AS term, round((only_b - additive) / 1e6, 4) AS sum_sq, la - 1.0::double AS df, round(((only_b - additive) / (la - 1)) / (additive / (n - la - 1)), 5) AS "F",
       CASE WHEN la = 3 THEN round(pow(additive / only_b, (n - la - 1) / 2.0), 6) END AS p FROM z
    UNION ALL SELECT 'l_linestatus', round(ssb_a / 1e6, 4), 1.0, round(ssb_a / (additive / (n - la - 1)), 5), NULL FROM z
    UNION ALL SELECT 'residual', round(additive / 1e6, 0), n - la - 1.0, NULL, NULL FROM z"""
)
def anova_two_way(spark, sf):
    out = stats.anova_two_way(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus")
    scaled = F.col("sum_sq") / 1e6
    shown = F.when(F.col("term") == "residual", F.round(scaled, 0)).otherwise(F.round(scaled, 4))
    return rounded(rounded(out.withColumns({"sum_sq": shown, "p": F.when(F.col("df") == 2, F.col("p"))}), 5, "F"), 6, "p")


@query(
    _TWO_WAY
    + """ SELECT 'l_returnflag:l_linestatus' AS term, round((additive - ssw) / 1e6, 4) AS sum_sq, cells - la - 1.0::double AS df,
       round(((additive - ssw) / (cells - la - 1)) / (ssw / (n - cells)), 5) AS "F",
       CASE WHEN cells = la + 3 THEN round(pow(ssw / additive, (n - cells) / 2.0), 6) END AS p FROM z WHERE cells > la + 1
    UNION ALL SELECT 'l_returnflag', round((only_b - additive) / 1e6, 4), la - 1.0::double, round(((only_b - additive) / (la - 1)) / (ssw / (n - cells)), 5),
       CASE WHEN la = 3 THEN round(pow(ssw / (ssw + only_b - additive), (n - cells) / 2.0), 6) END FROM z
    UNION ALL SELECT 'l_linestatus', round(ssb_a / 1e6, 4), 1.0, round(ssb_a / (ssw / (n - cells)), 5), NULL FROM z
    UNION ALL SELECT 'residual', round(ssw / 1e6, 0), n - cells * 1.0::double, NULL, NULL FROM z"""
)
def anova_interaction(spark, sf):
    out = stats.anova_two_way(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus", interaction=True)
    scaled = F.col("sum_sq") / 1e6
    shown = F.when(F.col("term") == "residual", F.round(scaled, 0)).otherwise(F.round(scaled, 4))
    return rounded(rounded(out.withColumns({"sum_sq": shown, "p": F.when(F.col("df") == 2, F.col("p"))}), 5, "F"), 6, "p")


@query(
    """
    WITH e AS (SELECT ln(o_totalprice) - avg(ln(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS e FROM orders),
    m AS (SELECT count(*) AS n, avg(e) AS mu FROM e),
    j AS (SELECT any_value(n) AS n, avg(pow(e - mu, 2)) AS m2, avg(pow(e - mu, 3)) AS m3, avg(pow(e - mu, 4)) AS m4 FROM e, m)
    SELECT n, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2), 6) AS kurtosis,
           round(n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 3) AS jarque_bera,
           round(exp(-n / 12 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4)), 6) AS p FROM j
    """
)
def residual_moments(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.ln("o_totalprice").alias("y"), "o_orderpriority")
    res = stats.group_residuals(rows, "y", "o_orderpriority")
    return rounded(rounded(stats.jarque_bera(res, "residual"), 6, "skew", "kurtosis", "p"), 3, "jarque_bera")


@query()
def normality(spark, sf):
    """W test on a 5,000-row sample of the residuals, beside the whole-table test."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.ln("o_totalprice").alias("y"), "o_orderpriority")
    return stats.normality(stats.group_residuals(rows, "y", "o_orderpriority"), "residual", ["o_orderkey"])


@query(
    """
    SELECT o_orderkey, o_orderpriority, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) + 0.0::double AS residual FROM orders
    """
)
def group_residuals(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(stats.group_residuals(rows, "o_totalprice", "o_orderpriority").drop("o_totalprice"), 4, "residual")


@query(
    """
    WITH e AS (SELECT o_orderkey, ln(o_totalprice) - (SELECT avg(ln(o_totalprice)) FROM orders) AS e FROM orders),
    l AS (SELECT e, e - lag(e) OVER (ORDER BY o_orderkey) AS d FROM e)
    SELECT round(sum(d * d) / sum(e * e), 6) AS durbin_watson FROM l
    """
)
def durbin_watson(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.ln("o_totalprice").alias("y"))
    e = o.withColumn("e", F.col("y") - o.agg(F.avg("y").alias("m")).scalar())
    return rounded(stats.durbin_watson(e, "e", "o_orderkey"), 6, "durbin_watson")


@query(
    f"""WITH {ols2_sql('lineitem', 'ln(l_extendedprice)', 'l_quantity', 'l_discount')}
    SELECT 'const' AS term, round(exp(b0), 3) AS effect FROM b UNION ALL SELECT 'l_quantity', round(exp(b1) - 1, 8) + 0.0::double FROM b
    UNION ALL SELECT 'l_discount', round(exp(b2) - 1, 8) + 0.0::double FROM b"""
)
def coefficient_effects(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", F.ln("l_extendedprice"))
    effects = stats.LinearFit(li, "y", ["l_quantity", "l_discount"]).effects()
    shown = F.when(F.col("term") == "const", F.round("effect", 3)).otherwise(F.round("effect", 8))
    return effects.withColumn("effect", shown + F.lit(0.0))
