"""Descriptive statistics, samples and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import profile
from lotwise.operators.models import best_by, sorted_results
from lotwise.operators.quantiles import column_modes, text_modes
from lotwise.operators.sampling import hash_split, stable_sample
from lotwise.operators.transformers import fill_with_medians
from lotwise.queries.base import place_sql, query, r, rounded, table, with_place


@query(
    """
    SELECT n_name, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(avg(o_totalprice), 4) AS mean, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name HAVING count(*) >= 30
    """
)
def group_price_stats(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rounded(profile.group_stats(rows.select("n_name", "o_totalprice"), "n_name", "o_totalprice", 30), 4, "median", "mean")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _describe_sql(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{p * 100:g}" for p in _PROBS)
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
               min({c}) AS min, max({c}) AS max, {q} FROM lineitem"""


@query(" UNION ALL ".join(_describe_sql(c) for c in _LINE))
def describe_numeric(spark, sf):
    out = profile.describe(table(spark, sf, "lineitem"), _LINE, _PROBS)
    return rounded(out, 6, "mean", "std", *[profile.percent_name(p) for p in _PROBS])


def _moments_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
      (SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, round(stddev_samp({c}), 6) AS std,
      round(var_samp({c}), 4) AS variance, round(skewness({c}), 6) + 0.0::double AS skewness, round(kurtosis({c}), 6) AS kurtosis,
      min({c}) AS min, max({c}) AS max, round(max({c}) - min({c}), 6) AS range FROM lineitem"""


@query(" UNION ALL ".join(_moments_sql(c) for c in _LINE))
def moments_corrected(spark, sf):
    out = profile.detailed_statistics(table(spark, sf, "lineitem"), _LINE)
    return rounded(rounded(out, 6, "mean", "median", "std", "skewness", "kurtosis", "range"), 4, "variance")


@query(
    """
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
    b AS (SELECT CAST(least(floor((o_totalprice - lo) * 50 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 50), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 50), 6) AS high,
           coalesce(n, 0) AS n FROM range(50) t(i), e LEFT JOIN b ON b.bin = i
    """
)
def histogram_width(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "orders"), "o_totalprice", 50), 6, "low", "high")


@query(
    f"""
    WITH c AS (SELECT c_acctbal, {place_sql('c_custkey')} FROM customer)
    SELECT CAST(floor(lat / 0.02) AS BIGINT) AS lat_cell, CAST(floor(lon / 0.02) AS BIGINT) AS lon_cell,
           round(avg(c_acctbal), 4) + 0.0::double AS mean, count(*) AS n FROM c GROUP BY 1, 2
    """
)
def scatter_grid(spark, sf):
    rows = with_place(table(spark, sf, "customer"), "c_custkey")
    return rounded(profile.grid_means(rows, "lat", "lon", "c_acctbal", 0.02), 4, "mean")


@query(
    """
    WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
               quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
               FROM lineitem GROUP BY 1)
    SELECT l_returnflag, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
           max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
           count(*) FILTER (l_extendedprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM lineitem JOIN q USING (l_returnflag) GROUP BY ALL
    """
)
def boxplot_groups(spark, sf):
    return rounded(profile.boxplot(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 6, "q1", "median", "q3")


@query(
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value, round(a - 1.5 * (b - a), 6) AS fence_low, round(b + 1.5 * (b - a), 6) AS fence_high
    FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)
    """
)
def iqr_outliers_(spark, sf):
    out = profile.iqr_outliers(table(spark, sf, "events").select("event_id", "value"), "value")
    return rounded(out, 6, "fence_low", "fence_high")


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gap"]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0::double AS corr FROM t"
    for i, a in enumerate(_CORR)
    for b in _CORR[i + 1:]
)


@query(
    "WITH t AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity * l_tax END AS gap FROM lineitem) " + _CORR_SQL
)
def corr_pairs(spark, sf):
    li = table(spark, sf, "lineitem").withColumn(
        "gap", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity") * F.col("l_tax"))
    )
    return rounded(profile.correlation_pairs(li, _CORR), 6, "corr")


@query(
    """
    WITH j AS (SELECT o_orderkey, o_orderstatus, c_acctbal,
               CASE WHEN o_orderkey % 97 = 0 THEN 'inf'::double WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END AS preco
               FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey)
    SELECT 'o_orderkey' AS "column", count(o_orderkey) AS non_null, count(*) - count(o_orderkey) AS nulls, 0::bigint AS infinite FROM j
    UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(*) - count(o_orderstatus), 0 FROM j
    UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(*) - count(c_acctbal), 0 FROM j
    UNION ALL SELECT 'preco', count(preco), count(*) - count(preco), count(*) FILTER (isinf(preco)) FROM j
    """
)
def null_profile_(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 0")
    key = F.col("o_orderkey")
    price = F.when(key % 97 == 0, F.lit(float("inf"))).when(key % 89 != 0, F.col("o_totalprice"))
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        "o_orderkey", "o_orderstatus", "c_acctbal", price.alias("preco")
    )
    return profile.null_profile(rows).drop("type")


@query(
    """
    SELECT 'l_quantity' AS "column", CAST(l_quantity AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY 2
    UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS BIGINT), count(*) FROM lineitem GROUP BY 2
    """
)
def int_frequencies_(spark, sf):
    return profile.int_frequencies(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"])


@query(
    """
    WITH s AS (SELECT count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
    v AS (SELECT l_quantity AS x, count(*) AS w FROM lineitem GROUP BY 1),
    g AS (SELECT i, (lo - 3 * h) + i * ((hi - lo + 6 * h) / 199) AS gx, h, n FROM range(200) t(i), s)
    SELECT CAST(i AS INT) AS point, round(gx, 6) + 0.0::double AS x,
           round(sum(w * exp(-((gx - v.x) / h) * ((gx - v.x) / h) / 2)) / (n * h * sqrt(2 * pi())), 10) AS density
    FROM g, v GROUP BY i, gx, n, h
    """
)
def kde_grid(spark, sf):
    out = profile.kernel_density(table(spark, sf, "lineitem"), "l_quantity", 200)
    return rounded(rounded(out, 6, "x"), 10, "density")


@query(
    """
    SELECT 's_nationkey' AS chave, count(DISTINCT s_nationkey) AS n FROM supplier
    UNION ALL SELECT 's_name', count(DISTINCT s_name) FROM supplier
    UNION ALL SELECT 'pares', count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)
    UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1
    UNION ALL SELECT 'total', count(*) FROM customer
    """
)
def key_profile(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    distinct = profile.distinct_counts(s, ["s_nationkey", "s_name"]).select(F.col("column").alias("chave"), F.col("distinct").alias("n"))
    pairs = c.select("c_nationkey", "c_mktsegment").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("pares").alias("chave"), "n")
    totals = profile.category_totals(c, "c_mktsegment").withColumnRenamed("c_mktsegment", "chave")
    return distinct.unionByName(pairs).unionByName(totals)


@query(
    """
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity END AS q,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS p,
               CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM t)) AS q,
           round(coalesce(p, (SELECT quantile_cont(p, 0.5) FROM t)), 6) AS p,
           coalesce(flag, (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag,
           (SELECT q FROM t WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1) AS moda FROM t
    """
)
def fill_statistics(spark, sf):
    li = table(spark, sf, "lineitem")
    part = F.col("l_partkey")
    rows = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(part % 7 != 0, F.col("l_quantity")).alias("q"),
        F.when(part % 5 != 0, F.col("l_extendedprice")).alias("p"),
        F.when(part % 6 != 0, F.col("l_returnflag")).alias("flag"),
    )
    mode = column_modes(rows, ["q"]).select("mode").scalar()
    filled = fill_with_medians(rows, ["q", "p"]).fillna(text_modes(rows, ["flag"]))
    return rounded(filled.withColumn("moda", mode), 6, "p")


_BRANDS = """SELECT p_brand AS "Model", round(avg(p_retailprice) / 1000, 6) AS "R2", round(stddev_samp(p_size), 6) AS "RMSE" FROM part GROUP BY 1"""


@query(f"""WITH b AS ({_BRANDS}) SELECT *, CAST(row_number() OVER (ORDER BY "R2" DESC, "RMSE", "Model") AS INT) AS position FROM b""")
def ranked_results(spark, sf):
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("Model")).agg(
        r(F.avg("p_retailprice") / 1000, 6).alias("R2"), r(F.stddev_samp("p_size"), 6).alias("RMSE")
    )
    return sorted_results(brands)


@query(f"""WITH b AS ({_BRANDS}) SELECT "Model", "R2" FROM b ORDER BY "R2" DESC LIMIT 1""")
def best_result(spark, sf):
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("Model")).agg(r(F.avg("p_retailprice") / 1000, 6).alias("R2"))
    return best_by(brands, "R2")


@query(
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 5000
    """
)
def stable_sample_(spark, sf):
    return stable_sample(table(spark, sf, "orders"), ["o_orderkey"], 5000).select("o_orderkey", "o_totalprice")


@query(
    """
    SELECT CASE WHEN substring(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) < 'cccccccd' THEN 'train' ELSE 'test' END AS part,
           count(*) AS n, sum(o_orderkey)::bigint AS keys FROM orders GROUP BY 1
    """
)
def hash_split_(spark, sf):
    train, test = hash_split(table(spark, sf, "orders"), ["o_orderkey"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
