"""Transformers, regressors, metrics, scoring and explanations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from lotwise.functions import rules
from lotwise.functions.numeric import log_target
from lotwise.functions.scores import RADII, SCORES, count_name, distance_name
from lotwise.operators import explain, models
from lotwise.operators.metrics import metric_columns, regression_metrics
from lotwise.operators.sampling import hash_split
from lotwise.operators.stats import LinearFit
from lotwise.operators.transformers import (
    ColumnScaler,
    DropFirstEncoder,
    FeatureAssembler,
    MedianImputer,
    ModeImputer,
    QuantileClipper,
    feature_names,
)
from lotwise.plans.prepare import prepare
from lotwise.plans.score import score
from lotwise.plans.serve import price_new_listings
from lotwise.plans.train import fit_full, train
from lotwise.queries.base import ols2_sql, place_sql, query, r, rounded, table, with_place
from lotwise.session import shared_folder
from lotwise.sources.predictions import read_predictions
from lotwise.sources.runs import load_model

NUMERIC = ["quartos", "banheiros", "vagas_garagem", "area_m2"]
TEXT = ["bairro", "faixa_area"]


def homes(spark, sf) -> DataFrame:
    """The part table seen as priced homes."""
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    rows = p.select(
        "p_partkey",
        F.when(k % 17 != 0, (size % 5).cast("double")).alias("quartos"),
        (k % 4).cast("double").alias("banheiros"),
        (size % 3).cast("double").alias("vagas_garagem"),
        (size * 3).cast("double").alias("area_m2"),
        F.when(k % 19 != 0, F.col("p_brand")).alias("bairro"),
        (F.col("p_retailprice") * size * (1 + (brand % 5) / 10) * (1 + (k % 4) / 20)).alias("preco"),
    )
    return rows.withColumns({"faixa_area": rules.area_band(F.col("area_m2")), "log_preco": log_target(F.col("preco"))})


_GAPS = "SELECT l_returnflag, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS a, l_quantity AS b FROM lineitem"
_SCALED = f"""
    WITH g AS ({_GAPS}), i AS (SELECT l_returnflag, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM g)) AS a, b FROM g),
    q AS (SELECT quantile_cont(a, 0.01) AS a1, quantile_cont(a, 0.99) AS a2, quantile_cont(b, 0.01) AS b1, quantile_cont(b, 0.99) AS b2 FROM i),
    c AS (SELECT l_returnflag, least(greatest(a, a1), a2) AS a, least(greatest(b, b1), b2) AS b FROM i, q),
    s AS (SELECT max(abs(a)) AS ma, max(abs(b)) AS mb, min(a) AS la, min(b) AS lb, max(a) - min(a) AS ra, max(b) - min(b) AS rb,
          quantile_cont(a, 0.5) AS qa, quantile_cont(b, 0.5) AS qb, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ia,
          quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS ib, avg(a) AS va, avg(b) AS vb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM c),
    x AS (SELECT 'none' AS scaler, l_returnflag, a, b FROM c UNION ALL SELECT 'max_abs', l_returnflag, a / ma, b / mb FROM c, s
      UNION ALL SELECT 'min_max', l_returnflag, (a - la) / ra, (b - lb) / rb FROM c, s
      UNION ALL SELECT 'normalizer', l_returnflag, a / sqrt(a * a + b * b), b / sqrt(a * a + b * b) FROM c
      UNION ALL SELECT 'robust', l_returnflag, (a - qa) / ia, (b - qb) / ib FROM c, s
      UNION ALL SELECT 'standard', l_returnflag, (a - va) / sa, (b - vb) / sb FROM c, s)
    SELECT scaler, l_returnflag, round(avg(a), 6) + 0.0::double AS mean_a, round(min(a), 6) + 0.0::double AS min_a, round(max(a), 6) + 0.0::double AS max_a,
           round(avg(b), 6) + 0.0::double AS mean_b, round(min(b), 6) + 0.0::double AS min_b, round(max(b), 6) + 0.0::double AS max_b FROM x GROUP BY 1, 2"""


@query(_SCALED)
def clip_scale(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        "l_returnflag", F.when(F.col("l_partkey") % 7 != 0, F.col("l_extendedprice")).alias("a"), F.col("l_quantity").alias("b")
    )
    cols = ["a", "b"]
    clipped = rows
    for step in (MedianImputer(cols), QuantileClipper(cols)):
        clipped = step.fit(clipped).transform(clipped)
    kinds = ("none", "max_abs", "min_max", "normalizer", "robust", "standard")
    scaled = clipped.select("l_returnflag", *[F.col(c).alias(f"{k}_{c}") for k in kinds for c in cols])
    for kind in kinds:  # every scaler has its own copy of the columns, so one aggregate reads them all
        own = [f"{kind}_{c}" for c in cols]
        fitted = ColumnScaler(own, kind).fit(clipped.select(*[F.col(c).alias(o) for c, o in zip(cols, own)]))
        scaled = fitted.transform(scaled)
    measures = (("mean", F.avg), ("min", F.min), ("max", F.max))
    wide = scaled.groupBy("l_returnflag").agg(*[
        F.struct(F.lit(k).alias("scaler"), *[f(f"{k}_{c}").alias(f"{n}_{c}") for c in cols for n, f in measures]).alias(k)
        for k in kinds
    ])
    out = wide.select("l_returnflag", F.inline(F.array(*kinds)))
    return rounded(out, 6, *[f"{n}_{c}" for c in cols for n in ("mean", "min", "max")])


@query(
    """
    WITH t AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN (SELECT p_type FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS p_type FROM part)
                      WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1) ELSE p_type END AS v, p_brand AS w FROM part),
    x AS (SELECT 'p_type_' || v AS name, v AS val, 1 AS grp FROM t UNION ALL SELECT 'p_brand_' || w, w, 2 FROM t)
    SELECT name, CAST(count(*) AS DOUBLE) AS total FROM x
    WHERE (grp = 1 AND val > (SELECT min(v) FROM t)) OR (grp = 2 AND val > (SELECT min(w) FROM t)) GROUP BY name
    """
)
def one_hot_drop_first(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("p_type"), "p_brand")
    cols = ["p_type", "p_brand"]
    rows = p
    steps = []
    for step in (ModeImputer(cols), DropFirstEncoder(cols), FeatureAssembler(numeric=[], text=cols)):
        fitted = step.fit(rows)
        rows = fitted.transform(rows)
        steps.append(fitted)
    names = feature_names(PipelineModel(steps), [], cols)
    slots = rows.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    sums = slots.groupBy("i").agg(F.sum("x").alias("total"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return sums.select(label.alias("name"), "total")


@query(
    """
    WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey || '-' || l_partkey END AS v FROM lineitem),
    d AS (SELECT v, row_number() OVER (ORDER BY v) - 2 AS slot, count(*) OVER () - 1 AS width FROM (SELECT DISTINCT v FROM t WHERE v IS NOT NULL))
    SELECT l_orderkey, l_linenumber, CASE WHEN slot >= 0 THEN slot END::bigint AS slot, (SELECT max(width) FROM d)::bigint AS width FROM t LEFT JOIN d USING (v)
    """
)
def wide_one_hot(spark, sf):
    """A text column with almost as many values as rows: the place of the one in its vector, and the vector's width."""
    k = F.col("l_orderkey")
    text = F.concat(k.cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(k % 50 != 0, text).alias("v"))
    fitted = DropFirstEncoder(["v"], widest=1000).fit(rows)
    width = fitted.stages[-1].categorySizes[0] - 1
    slot = F.when(F.col("v_index") < width, F.col("v_index").cast("long"))
    return fitted.transform(rows).select("l_orderkey", "l_linenumber", slot.alias("slot"), F.lit(width).cast("long").alias("width"))


_LINE2 = ols2_sql("lineitem", "l_extendedprice", "l_quantity", "l_discount")


@query(
    f"""WITH {_LINE2}, v AS (SELECT *, sse / (n - 3) AS s2 FROM b)
    SELECT 'const' AS term, round(b0, 4) AS coef, round(sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * det))), 4) AS std_err FROM v
    UNION ALL SELECT 'l_quantity', round(b1, 4) + 0.0::double, round(sqrt(s2 * s22 / (n * det)), 4) FROM v
    UNION ALL SELECT 'l_discount', round(b2, 4) + 0.0::double, round(sqrt(s2 * s11 / (n * det)), 4) FROM v"""
)
def ols_coefficients(spark, sf):
    fit = LinearFit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(fit.coefficients().select("term", "coef", "std_err"), 4, "coef", "std_err")


@query(
    f"""WITH {_LINE2}, p AS (SELECT l_orderkey, y - b0 - b1 * x1 - b2 * x2 AS e FROM t, b),
    j AS (SELECT count(*) AS n, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM p)
    SELECT j.n, round(1 - sse / (j.n * syy), 8) AS r2, round(1 - (sse / (j.n - 3)) / (j.n * syy / (j.n - 1)), 8) AS adj_r2,
           round(((j.n * syy - sse) / 2) / (sse / (j.n - 3)), 4) AS f,
           round(j.n * (ln(2 * pi()) + ln(sse / j.n) + 1) + 6, 2) AS aic,
           round(j.n * (ln(2 * pi()) + ln(sse / j.n) + 1) + 3 * ln(j.n), 2) AS bic,
           round(m3 / pow(m2, 1.5), 6) + 0.0::double AS skew, round(m4 / (m2 * m2), 6) AS kurtosis,
           round(j.n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 3) AS jarque_bera FROM j, (SELECT sse, syy FROM b)"""
)
def ols_summary(spark, sf):
    fit = LinearFit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    s = fit.summary().drop("f_p", "jb_p")
    s = rounded(rounded(s, 8, "r2", "adj_r2"), 6, "skew", "kurtosis")
    return rounded(rounded(rounded(s, 4, "f"), 2, "aic", "bic"), 3, "jarque_bera")


def _vectors(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    return FeatureAssembler(numeric=cols, text=[]).fit(df).transform(df).select("features", label)


def _weights(spark, model, names: list[str], digits: int) -> DataFrame:
    rows = [("const", float(model.intercept)), *zip(names, [float(v) for v in model.coefficients])]
    return rounded(spark.createDataFrame(rows, "term string, coef double"), digits, "coef")


_EVENTS2 = ols2_sql("(SELECT ln(1 + value) AS lv, * FROM events)", "lv", "user_id / 1000.0::double", "json_extract_string(props, '$.k')::double / 100")
_TWO = ["u", "k"]


def _event_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.log1p("value").alias("y"),
        (F.col("user_id") / F.lit(1000.0)).alias("u"),
        (F.from_json("props", "k double")["k"] / 100).alias("k"),
    )


@query(
    f"""WITH {_EVENTS2}, w AS (SELECT *, s11 + 1.0 / n AS a11, s22 + 1.0 / n AS a22 FROM c),
    z AS (SELECT *, (a22 * s1y - s12 * s2y) / (a11 * a22 - s12 * s12) AS w1, (a11 * s2y - s12 * s1y) / (a11 * a22 - s12 * s12) AS w2 FROM w)
    SELECT 'const' AS term, round(my - w1 * m1 - w2 * m2, 6) AS coef FROM z
    UNION ALL SELECT 'u', round(w1, 6) + 0.0::double FROM z UNION ALL SELECT 'k', round(w2, 6) + 0.0::double FROM z"""
)
def ridge_coefficients(spark, sf):
    rows = _vectors(_event_rows(spark, sf), _TWO, "y")
    return _weights(spark, models.ridge(rows, "y").fit(rows), _TWO, 6)


def _soft(alpha: float, rho: float) -> str:
    return f"""WITH t AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem),
    m AS (SELECT avg(y) AS my, avg(x) AS mx, covar_pop(x, y) AS c, var_pop(x) AS v FROM t),
    w AS (SELECT *, sign(c) * greatest(abs(c) - {alpha * rho}::double, 0) / (v + {alpha * (1 - rho)}::double) AS w FROM m)
    SELECT 'const' AS term, round(my - w * mx, 5) AS coef FROM w UNION ALL SELECT 'x', round(w, 5) + 0.0::double FROM w"""


def _one_feature(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    rows = li.select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))
    return _vectors(rows, ["x"], "y")


@query(_soft(0.1, 1.0))
def lasso_coefficients(spark, sf):
    rows = _one_feature(spark, sf)
    return _weights(spark, models.lasso(rows, "y", 0.1).fit(rows), ["x"], 5)


@query(_soft(2.0, 0.5))
def elastic_net_coefficients(spark, sf):
    rows = _one_feature(spark, sf)
    return _weights(spark, models.elastic_net(rows, "y", 2.0, 0.5).fit(rows), ["x"], 5)


_METRICS = """round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
    round(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 8) AS mape, round(avg(e * e), 2) AS mse"""


def _round_metrics(df: DataFrame) -> DataFrame:
    return rounded(rounded(rounded(df, 8, "r2", "mape"), 6, "rmse", "mae"), 2, "mse")


@query(f"SELECT {_METRICS} FROM (SELECT l_extendedprice AS y, l_extendedprice - (2000 * l_quantity + 500) AS e FROM lineitem)")
def regression_metrics_(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("prediction", F.col("l_quantity") * 2000 + 500)
    return _round_metrics(regression_metrics(rows, "l_extendedprice"))


@query(
    f"""WITH {_LINE2}, e AS (SELECT y, y - b0 - b1 * x1 - b2 * x2 AS e, y - my AS base FROM t, b)
    SELECT round(1 - sum(e * e) / sum(base * base), 6) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
           round(0.0::double, 6) AS baseline_r2, round(sqrt(avg(base * base)), 4) AS baseline_rmse, round(avg(abs(base)), 4) AS baseline_mae FROM e"""
)
def baseline_compare(spark, sf):
    fit = LinearFit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    rows = fit.df.select(
        F.col("l_extendedprice").alias("y"), fit.predicted().alias("p"),
    )
    mean = rows.agg(F.avg("y").alias("m")).scalar()
    both = rows.withColumn("m", mean)
    out = both.agg(
        *[c for c in metric_columns("y", "p")[:3]],
        *[c.alias(f"baseline_{n}") for n, c in zip(("r2", "rmse", "mae"), metric_columns("y", "m")[:3])],
    )
    return rounded(rounded(out, 6, "r2", "baseline_r2"), 4, "rmse", "mae", "baseline_rmse", "baseline_mae")


@query()
def model_grid(spark, sf):
    """All eight models under all six scalers; the two large ensembles with fewer trees (README has the times of all)."""
    train_rows, test_rows = hash_split(homes(spark, sf), ["p_partkey"])
    light = {
        **models.GRID,
        "RandomForest": lambda df, label: models.random_forest(df, label, trees=10, max_depth=8),
        "XGBoost": lambda df, label: models.penalised_boosting(df, label, n_estimators=10),
    }
    return models.compare_grid(train_rows, test_rows, "log_preco", NUMERIC, TEXT, light)


@query()
def five_models(spark, sf):
    """The five-model comparison with its report."""
    board = models.ModelComparison(homes(spark, sf), "log_preco", NUMERIC, ["p_partkey"]).prepare().fit_all()
    return board.report()


@query()
def param_search(spark, sf):
    """Fifty trials over the full ranges."""
    _, board = models.search(homes(spark, sf), "log_preco", NUMERIC, TEXT, ["p_partkey"])
    return board


_CLIPPED = ols2_sql(
    """(SELECT l_orderkey, l_linenumber, l_partkey, ln(l_extendedprice) AS ly, least(greatest(l_quantity, q1), q2) AS cq, least(greatest(l_discount, d1), d2) AS cd
        FROM lineitem, (SELECT quantile_cont(l_quantity, 0.01) AS q1, quantile_cont(l_quantity, 0.99) AS q2,
             quantile_cont(l_discount, 0.01) AS d1, quantile_cont(l_discount, 0.99) AS d2 FROM lineitem))""",
    "ly", "cq", "cd",
)


@query(
    f"""WITH {_CLIPPED} SELECT l_orderkey, l_partkey, l_linenumber, round(b0 + b1 * x1 + b2 * x2, 6) AS log_preco,
        round(exp(b0 + b1 * x1 + b2 * x2), 1) AS preco_estimado, 'BRL' AS moeda FROM t, b"""
)
def batch_score(spark, sf):
    """A saved and reloaded linear pipeline scores the whole table."""
    li = table(spark, sf, "lineitem").withColumn("log_preco", F.ln("l_extendedprice"))
    numeric = ["l_quantity", "l_discount"]
    fitted = fit_full(li, LinearRegression(labelCol="log_preco", solver="normal"), "log_preco", numeric, [])
    folder = shared_folder(spark, "model")
    fitted.write().overwrite().save(folder)
    out = score(load_model(spark, model_path=folder), li.drop("log_preco"))
    return out.select(
        "l_orderkey", "l_partkey", "l_linenumber", r("log_preco", 6).alias("log_preco"),
        r(F.exp("log_preco"), 1).alias("preco_estimado"), "moeda",
    )


_DEFAULTED = ols2_sql(
    """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, ln(l_extendedprice) AS ly, least(greatest(l_quantity, q1), q2) AS cq, least(greatest(l_discount, d1), d2) AS cd,
        q1, q2, qm FROM lineitem, (SELECT quantile_cont(l_quantity, 0.01) AS q1, quantile_cont(l_quantity, 0.99) AS q2, quantile_cont(l_quantity, 0.5) AS qm,
             quantile_cont(l_discount, 0.01) AS d1, quantile_cont(l_discount, 0.99) AS d2 FROM lineitem))""",
    "ly", "cq", "cd",
)


@query(
    f"""WITH {_DEFAULTED}, p AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS v FROM t, b)
    SELECT l_orderkey, l_partkey, l_linenumber, 'zero' AS missing, round(b0 + b1 * least(greatest(coalesce(v, 0), q1), q2) + b2 * x2, 6) AS log_preco FROM p
    UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'impute', round(b0 + b1 * least(greatest(coalesce(v, qm), q1), q2) + b2 * x2, 6) FROM p"""
)
def default_scores(spark, sf):
    """Absent parking spaces count as zero, or as the fitted median, in the stored prices."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.ln("l_extendedprice").alias("log_preco"), F.col("l_quantity").alias("vagas_garagem"),
        F.col("l_discount").alias("area_m2"),
    )
    fitted = fit_full(li, LinearRegression(labelCol="log_preco", solver="normal"), "log_preco", ["vagas_garagem", "area_m2"], [])
    rows = li.drop("log_preco").withColumn("vagas_garagem", F.when(F.col("l_partkey") % 3 != 0, F.col("vagas_garagem")))
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    zero, impute = (
        score(fitted, rows, missing).select(*keys, F.lit(missing).alias("missing"), r("log_preco", 6).alias("log_preco"))
        for missing in ("zero", "impute")
    )
    return zero.unionByName(impute)


@query()
def train_and_register(spark, sf):
    """Search, final fit, baseline, run log and registry; returns the logged metrics."""
    folder = shared_folder(spark, "training")
    result = train(homes(spark, sf), ["p_partkey"], folder, numeric=NUMERIC, text=TEXT)
    scored = score(load_model(spark, folder, "prices"), homes(spark, sf).drop("log_preco", "preco"), "zero")
    logged = spark.read.parquet(f"{folder}/runs").where(F.col("run_id") == result.run_id)
    metrics = logged.select(F.explode("metrics").alias("metric", "value"))
    rows = scored.agg(F.count("preco_estimado").cast("double").alias("value")).select(F.lit("scored_rows").alias("metric"), "value")
    return metrics.unionByName(rows)


_STEPS = ["x0", "x1", "x2"]
_STEP_ROWS = """t0 AS (SELECT p_partkey, CAST(p_partkey % 4 AS DOUBLE) AS x0, CAST(p_size % 3 AS DOUBLE) AS x1, CAST(p_size % 5 AS DOUBLE) AS x2,
    p_retailprice / 100 * (1 + (p_partkey % 4) / 20.0::double) * (1 + (p_size % 3) / 10.0::double) AS y FROM part)"""


def _stump_sql(source: str, target: str, name: str) -> str:
    """CTE `name`: the rows of `source` with the split of least squared error, as {name}_f, {name}_p and {name}_m."""
    long = " UNION ALL ".join(f"SELECT {i} AS f, {x} AS x, {target} AS t FROM {source}" for i, x in enumerate(_STEPS))
    return f"""
    {name}_v AS (SELECT f, x, CAST(count(*) AS DOUBLE) AS n, sum(t) AS s FROM ({long}) GROUP BY 1, 2),
    {name}_c AS (SELECT f, x, sum(n) OVER (PARTITION BY f ORDER BY x) AS nl, sum(s) OVER (PARTITION BY f ORDER BY x) AS sl,
        sum(n) OVER (PARTITION BY f) AS na, sum(s) OVER (PARTITION BY f) AS sa FROM {name}_v),
    {name}_b AS (SELECT * FROM {name}_c WHERE nl < na ORDER BY sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) DESC, f, x LIMIT 1),
    {name} AS (SELECT r.*, b.f AS {name}_f, sa / na AS {name}_m,
        CASE WHEN CASE b.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= b.x THEN sl / nl ELSE (sa - sl) / (na - nl) END AS {name}_p
        FROM {source} r, {name}_b b)"""


_STUMP = f"WITH {_STEP_ROWS}, {_stump_sql('t0', 'y', 'a')}"
_TWO_STUMPS = f"{_STUMP}, {_stump_sql('a', '2 * (y - a_p)', 'b')}"  # the second tree is fitted to the negative gradient


def _step_rows(spark, sf) -> DataFrame:
    """Prices that depend on features of few values, so that every possible split is tried."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", (k % 4).cast("double").alias("x0"), (size % 3).cast("double").alias("x1"), (size % 5).cast("double").alias("x2"),
        (F.col("p_retailprice") / 100 * (1 + (k % 4) / F.lit(20.0)) * (1 + (size % 3) / F.lit(10.0))).alias("y"),
    )
    return FeatureAssembler(numeric=_STEPS, text=[]).fit(rows).transform(rows)


def _two_stumps(rows: DataFrame):
    return models.sampled_boosting(rows, "y", 2, learning_rate=0.5, max_depth=1, subsample=1.0, colsample_bytree=1.0).fit(rows)


@query(f"{_STUMP} SELECT p_partkey, round(a_p, 6) AS prediction FROM a")
def tree_stump(spark, sf):
    """A regression tree of one split."""
    rows = _step_rows(spark, sf)
    return rounded(models.decision_tree(rows, "y", max_depth=1).fit(rows).transform(rows).select("p_partkey", "prediction"), 6, "prediction")


@query(f"{_TWO_STUMPS} SELECT p_partkey, round(a_p + 0.5::double * b_p, 6) AS prediction FROM b")
def boosted_stumps(spark, sf):
    """Two boosted trees of one split each."""
    rows = _step_rows(spark, sf)
    return rounded(_two_stumps(rows).transform(rows).select("p_partkey", "prediction"), 6, "prediction")


@query(
    f"{_TWO_STUMPS} "
    + " UNION ALL ".join(
        f"SELECT p_partkey, '{x}' AS feature, {x} AS value, round(CASE a_f WHEN {i} THEN a_p - a_m ELSE 0 END "
        f"+ 0.5::double * CASE b_f WHEN {i} THEN b_p - b_m ELSE 0 END, 6) + 0.0::double AS phi FROM b"
        for i, x in enumerate(_STEPS)
    )
)
def stump_contributions(spark, sf):
    """Contributions of every feature to the two boosted trees, row by row."""
    rows = _step_rows(spark, sf)
    model = _two_stumps(rows)
    out = explain.explain_trees(model, model.transform(rows), _STEPS)
    return rounded(explain.contribution_table(out, ["p_partkey"]), 6, "phi")


_ALPHA, _LAMBDA, _RATE = 3.5, 20.0, 0.3


def _best_split(name: str, source: str, node: str, alpha: float, lam: float) -> str:
    """CTE `name`: per node (an expression over `source`) its totals and its best split of the gradient g."""
    long = " UNION ALL ".join(f"SELECT {node} AS node, {i} AS f, {x} AS x, g FROM {source}" for i, x in enumerate(_STEPS))
    score = lambda g, n: f"pow(greatest(abs({g}) - {alpha}::double, 0), 2) / ({n} + {lam}::double)"
    return f"""
    {name}_v AS (SELECT node, f, x, CAST(count(*) AS DOUBLE) AS n, sum(g) AS s FROM ({long}) GROUP BY 1, 2, 3),
    {name}_c AS (SELECT node, f, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY node, f) AS na, sum(s) OVER (PARTITION BY node, f) AS sa
        FROM {name}_v WINDOW w AS (PARTITION BY node, f ORDER BY x)),
    {name}_g AS (SELECT *, {score('sl', 'nl')} + {score('(sa - sl)', '(na - nl)')} - {score('sa', 'na')} AS gain FROM {name}_c WHERE nl < na),
    {name} AS (SELECT * FROM {name}_g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, x) = 1)"""


def _side(split: str) -> str:
    return f"CASE {split}.f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= {split}.x"


def _tree_sql(k: int, depth: int, alpha: float = _ALPHA, lam: float = _LAMBDA, rate: float = _RATE, gradient: str = "p - y") -> str:
    """CTEs of the k-th tree: its nodes tree{k} (node, f, x of the split or null, value v, rows n) and, from the rows p{k},
    the rows p{k + 1} with a prediction further on."""
    leaf = f"-sign(s) * greatest(abs(s) - {alpha}::double, 0) / (n + {lam}::double)"
    out, nodes = [f"d{k}_0 AS (SELECT p_partkey, x0, x1, x2, y, p, {gradient} AS g, 0 AS node FROM p{k})"], []
    for level in range(depth):
        best, source = f"b{k}_{level}", f"d{k}_{level}"
        out.append(_best_split(best, f"(SELECT * FROM {source} WHERE node >= {2**level - 1})", "node", alpha, lam))
        nodes.append(f"SELECT r.node, b.f, b.x, s, n FROM m{k}_{level} r LEFT JOIN {best} b USING (node)")
        out.append(f"m{k}_{level} AS (SELECT node, sum(g) AS s, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE node >= {2**level - 1} GROUP BY 1)")
        out.append(f"""d{k}_{level + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN r.node WHEN {_side('b')} THEN 2 * r.node + 1
            ELSE 2 * r.node + 2 END AS node FROM {source} r LEFT JOIN {best} b ON b.node = r.node)""")
    ends = f"SELECT node, NULL AS f, NULL AS x, sum(g) AS s, CAST(count(*) AS DOUBLE) AS n FROM d{k}_{depth} WHERE node >= {2**depth - 1} GROUP BY 1"
    out.append(f"tree{k} AS (SELECT *, {leaf} AS v FROM ({' UNION ALL '.join([*nodes, ends])}))")
    out.append(f"p{k + 1} AS (SELECT r.* EXCLUDE (p, g, node), p + {rate}::double * v AS p FROM d{k}_{depth} r JOIN tree{k} USING (node))")
    return ", ".join(out)


def _penalised_sql(trees: int, depth: int) -> str:
    grown = ", ".join(_tree_sql(k, depth) for k in range(trees))
    return f"WITH {_STEP_ROWS}, p0 AS (SELECT *, avg(y) OVER () AS p FROM t0), {grown}"


def _penalised(rows: DataFrame, trees: int, depth: int):
    return models.penalised_boosting(
        rows, "y", n_estimators=trees, learning_rate=_RATE, max_depth=depth, subsample=1.0, colsample_bytree=1.0,
        reg_alpha=_ALPHA, reg_lambda=_LAMBDA,
    ).fit(rows)


@query(f"{_penalised_sql(3, 2)} SELECT p_partkey, round(p, 6) AS prediction FROM p3")
def penalised_trees(spark, sf):
    """Three boosted trees of depth two with L1 and L2 leaf penalties, row by row."""
    rows = _step_rows(spark, sf)
    return rounded(_penalised(rows, 3, 2).transform(rows).select("p_partkey", "prediction"), 6, "prediction")


@query(
    f"{_penalised_sql(3, 2)} "
    + " UNION ALL ".join(
        f"SELECT {k} AS tree, CAST(node AS INT) AS node, CAST(f AS INT) AS feature, round(v, 6) + 0.0::double AS value, n AS n_rows FROM tree{k}"
        for k in range(3)
    )
)
def penalised_nodes(spark, sf):
    """The nodes of the same trees: split feature (null at a leaf), value and rows."""
    rows = _step_rows(spark, sf)
    nodes = [
        (k, i, n[4] if n[0] > 0 else None, float(n[2]), float(n[3]))
        for k, heap in enumerate(_penalised(rows, 3, 2).heaps()) for i, n in heap.items()
    ]
    return rounded(spark.createDataFrame(nodes, "tree int, node int, feature int, value double, n_rows double"), 6, "value")


def _plain_boosting_sql(trees: int, depth: int) -> str:
    """A regression tree, and further ones of a tenth of its weight, each fitted to twice what is left."""
    first = _tree_sql(0, depth, 0.0, 0.0, 1.0, "-y")
    rest = "".join(f", {_tree_sql(k, depth, 0.0, 0.0, 0.1, '-2 * (y - p)')}" for k in range(1, trees))
    return f"WITH {_STEP_ROWS}, p0 AS (SELECT *, 0.0::double AS p FROM t0), {first}{rest}"


@query(f"{_plain_boosting_sql(1, 3)} SELECT p_partkey, round(p, 4) AS prediction FROM p1")
def forest_tree(spark, sf):
    """A forest of two trees of depth three without resampling, each of which sees every row and feature."""
    rows = _step_rows(spark, sf)
    out = models.random_forest(rows, "y", trees=2, max_depth=3).setBootstrap(False).fit(rows).transform(rows)
    return rounded(out.select("p_partkey", "prediction"), 4, "prediction")


@query(f"{_plain_boosting_sql(4, 3)} SELECT p_partkey, round(p, 6) AS prediction FROM p4")
def boosted_trees(spark, sf):
    """Four rounds of gradient boosting at its usual depth and rate."""
    rows = _step_rows(spark, sf)
    out = models.gradient_boosting(rows, "y", rounds=4).fit(rows).transform(rows)
    return rounded(out.select("p_partkey", "prediction"), 6, "prediction")


def _subset_value(i: int, depth: int) -> str:
    """Value of node i of one tree for a row of which only the features in `mask` are known."""
    if i >= 2**depth - 1:
        return f"v{i}"
    left, right = _subset_value(2 * i + 1, depth), _subset_value(2 * i + 2, depth)
    return f"""CASE WHEN f{i} IS NULL THEN v{i} WHEN (mask >> f{i}) & 1 = 1 THEN CASE WHEN CASE f{i} WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= c{i}
        THEN {left} ELSE {right} END ELSE (n{2 * i + 1} * ({left}) + n{2 * i + 2} * ({right})) / n{i} END"""


def _subset_sql(trees: int, depth: int) -> str:
    """Contributions as averages over all subsets of the other features."""
    wide = [
        f"w{k} AS (SELECT " + ", ".join(f"max({c}) FILTER (node = {i}) AS {n}{i}" for i in range(2 ** (depth + 1) - 1) for c, n in (("f", "f"), ("x", "c"), ("v", "v"), ("n", "n")))
        + f" FROM tree{k})" for k in range(trees)
    ]
    each = " UNION ALL ".join(f"SELECT p_partkey, mask, {_subset_value(0, depth)} AS u FROM t0_m, w{k}" for k in range(trees))
    phi = " UNION ALL ".join(
        f"""SELECT p_partkey, '{x}' AS feature, {x} AS value, round({_RATE}::double * sum(u * CASE WHEN (mask >> {i}) & 1 = 1 THEN 1 ELSE -1 END
            / CASE bit_count(mask & ~{1 << i}) WHEN 1 THEN 6.0::double ELSE 3.0::double END), 6) + 0.0::double AS phi FROM e JOIN t0 USING (p_partkey) GROUP BY ALL"""
        for i, x in enumerate(_STEPS)
    )
    return f"{_penalised_sql(trees, depth)}, {', '.join(wide)}, t0_m AS (SELECT t0.*, unnest(range(8))::int AS mask FROM t0), e AS ({each}) {phi}"


@query(_subset_sql(2, 3))
def deep_contributions(spark, sf):
    """Contributions to two penalised trees of depth three, against averages over all subsets of features."""
    rows = _step_rows(spark, sf)
    model = _penalised(rows, 2, 3)
    out = explain.explain_trees(model, model.transform(rows), _STEPS)
    return rounded(explain.contribution_table(out, ["p_partkey"]), 6, "phi")


_LINE_TERMS = f"""WITH {_LINE2}, p AS (SELECT l_orderkey, l_partkey, l_linenumber, b0 + b1 * m1 + b2 * m2 AS base, x1, x2, b1 * (x1 - m1) AS f1, b2 * (x2 - m2) AS f2 FROM t, b)"""


def _line_terms(spark, sf) -> DataFrame:
    fit = LinearFit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return explain.linear_terms(fit.df, fit.features, fit.slopes.tolist(), fit.intercept)


@query(
    _LINE_TERMS
    + """ SELECT l_orderkey, l_partkey, l_linenumber, 'l_quantity' AS feature, x1 AS value, round(f1, 4) + 0.0::double AS phi FROM p
    UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, 'l_discount', x2, round(f2, 4) + 0.0::double FROM p"""
)
def linear_contributions(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    return rounded(explain.contribution_table(_line_terms(spark, sf), keys), 4, "phi")


@query(
    _LINE_TERMS
    + " SELECT 'l_quantity' AS feature, round(avg(abs(f1)), 4) AS importance FROM p UNION ALL SELECT 'l_discount', round(avg(abs(f2)), 4) FROM p"
)
def global_importance(spark, sf):
    return rounded(explain.global_importance(_line_terms(spark, sf)), 4, "importance")


@query(
    _LINE_TERMS
    + " SELECT l_orderkey, l_partkey, l_linenumber, 'l_quantity' AS feature, x1 AS value, round(f1, 4) + 0.0::double AS phi FROM p"
)
def feature_dependence(spark, sf):
    """Value and contribution of one feature for every row."""
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    return rounded(explain.dependence(_line_terms(spark, sf), keys, "l_quantity"), 4, "phi")


@query(
    _LINE_TERMS
    + """, u AS (SELECT l_orderkey, l_partkey, l_linenumber, base, CASE WHEN abs(f1) >= abs(f2) THEN 'l_quantity' ELSE 'l_discount' END AS top,
         CASE WHEN abs(f1) >= abs(f2) THEN x1 ELSE x2 END AS v, CASE WHEN abs(f1) >= abs(f2) THEN f1 ELSE f2 END AS big,
         CASE WHEN abs(f1) >= abs(f2) THEN f2 ELSE f1 END AS small FROM p)
    SELECT l_orderkey, l_partkey, l_linenumber, round(base, 4) AS base, 1 AS position, top AS feature, v AS value, round(big, 4) + 0.0::double AS phi FROM u
    UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, round(base, 4), 2, 'other', NULL, round(small, 4) + 0.0::double FROM u"""
)
def local_explanation(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    return rounded(explain.local_explanation(_line_terms(spark, sf), keys, top=1), 4, "base", "phi")


@query("SELECT count(*) AS n, 0.0::double AS largest_gap, 31::bigint AS features FROM part")
def tree_contributions(spark, sf):
    """Boosted-tree contributions of every row; base and contributions must add up to the prediction."""
    rows = homes(spark, sf)
    fitted = fit_full(rows, models.sampled_boosting(rows, "log_preco", n_estimators=5, max_depth=4), "log_preco", NUMERIC, TEXT)
    names = feature_names(fitted, NUMERIC, TEXT)
    out = explain.explain_trees(fitted.stages[-1], fitted.transform(rows), names)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["phi"])
    return out.agg(
        F.count(F.lit(1)).alias("n"),
        r(F.max(F.abs(total - F.col("prediction"))), 8).alias("largest_gap"),
        F.max(F.size("contributions")).cast("long").alias("features"),
    )


@query(
    """
    WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size * 3 AS DOUBLE) END AS area_m2,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice * p_size END AS preco, CAST(p_size * 20 AS DOUBLE) AS d, p_size % 4 AS q,
        list_extract(['Casa', 'Apartamento', 'Lote', 'Sala', 'Fazenda'], CAST(p_partkey % 5 + 1 AS INT)) AS tipo FROM part),
    f AS (SELECT *, CASE tipo WHEN 'Casa' THEN 'casa' WHEN 'Apartamento' THEN 'apartamento' ELSE 'comercial' END AS tipo_imovel_cat FROM a WHERE tipo IN ('Casa', 'Apartamento', 'Sala'))
    SELECT p_partkey, tipo_imovel_cat,
       CASE WHEN area_m2 <= 50 THEN 'Até 50' WHEN area_m2 <= 80 THEN '50–80' WHEN area_m2 <= 120 THEN '80–120' WHEN area_m2 <= 200 THEN '120–200' END AS faixa_area,
       coalesce(area_m2, (SELECT quantile_cont(area_m2, 0.5) FROM f)) AS area_m2,
       round(coalesce(CASE WHEN preco IS NOT NULL THEN ln(greatest(preco, 1)) END, (SELECT quantile_cont(ln(preco), 0.5) FROM f WHERE preco IS NOT NULL)), 6) AS log_preco,
       round(1.2::double * exp(-d / 600) + 0.6::double * q, 6) AS score_escola_privada, round(exp(-d / 1500) + 0.3::double * q, 6) AS score_seguranca,
       round(1.2::double * exp(-d / 600) + 0.6::double * q - 0.2::double * (0.6::double * exp(-d / 600) + 0.2::double * q), 6) AS score_educacao FROM f
    """
)
def prepare_flow(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*[F.lit(t) for t in ("Casa", "Apartamento", "Lote", "Sala", "Fazenda")])
    rows = p.select(
        "p_partkey",
        F.lit(0).alias("Unnamed: 0"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("tipo_imovel"),
        F.when(k % 13 != 0, (size * 3).cast("double")).alias("area_m2"),
        F.when(k % 11 != 0, F.col("p_retailprice") * size).alias("preco"),
        *[(size * 20).cast("double").alias(distance_name(c)) for c in RADII],
        *[(size % 4).cast("long").alias(count_name(c, m)) for c, m in RADII.items()],
    )
    scores = ["score_escola_privada", "score_seguranca", "score_educacao"]
    out = prepare(rows).select("p_partkey", "tipo_imovel_cat", "faixa_area", "area_m2", "log_preco", *scores)
    return rounded(out, 6, "log_preco", *scores)


def _new_listings(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as new listings, a cache of their addresses with gaps, and suppliers as places."""
    c = with_place(table(spark, sf, "customer"), "c_custkey")
    k = F.col("c_custkey")
    new = c.select(
        k,
        F.when(k % 11 != 0, F.col("c_name")).otherwise(F.lit(" ")).alias("rua"), F.col("c_mktsegment").alias("bairro"),
        F.lit("Cidade").alias("cidade"), F.lit("PR").alias("estado"), (F.abs("c_acctbal") / 20).alias("area_m2"),
        (k % 5).alias("quartos"), (k % 3).alias("banheiros"), (k % 2).alias("vagas_garagem"),
    )
    known = k % 5 != 0
    cache = c.where(k % 7 != 0).select(
        F.concat_ws(", ", "c_name", "c_mktsegment", F.lit("Cidade"), F.lit("PR"), F.lit("Brasil")).alias("endereco_geo"),
        F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"),
    )
    names = F.array(*[F.lit(n) for n in RADII])
    poi = with_place(table(spark, sf, "supplier"), "s_suppkey").select(
        F.element_at(names, (F.col("s_nationkey") % 7 + 1).cast("int")).alias("category"), "lat", "lon"
    )
    return new, cache, poi


@query(
    """
    SELECT CASE WHEN c_custkey % 11 = 0 THEN 'sem_endereco' WHEN c_custkey % 7 = 0 THEN 'erro' WHEN c_custkey % 5 = 0 THEN 'nao_encontrado' ELSE 'sucesso' END AS status,
           count(*) AS n, count(*) FILTER (c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 <> 0) AS gravadas FROM customer GROUP BY 1
    """
)
def online_flow(spark, sf):
    """Every customer as a new listing: resolved, featured, priced and appended, or set aside."""
    new, cache, poi = _new_listings(spark, sf)
    rows = homes(spark, sf)
    model = fit_full(rows, models.linear(rows, "log_preco"), "log_preco", NUMERIC, ["faixa_area"])
    folder = shared_folder(spark, "online")
    _, aside = price_new_listings(new, cache, poi, model, "modelo", "1.0.0", folder)
    stored = read_predictions(spark, folder).where("preco_predito > 0 and score_parque is not null")
    done = stored.groupBy(F.lit("sucesso").alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("gravadas", F.col("n"))
    rest = aside.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("gravadas", F.lit(0).cast("long"))
    return done.unionByName(rest)


_HOMES2 = ols2_sql(
    """(SELECT ln(greatest(p_retailprice * p_size * (1 + (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 5) / 10.0::double) * (1 + (p_partkey % 4) / 20.0::double), 1)) AS ly,
        least(greatest(a, a1), a2) AS ca, least(greatest(coalesce(q, qm), q1), q2) AS cq, a1, a2, q1, q2, qm
        FROM (SELECT *, CAST(p_size * 3 AS DOUBLE) AS a, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS q FROM part),
          (SELECT quantile_cont(a, 0.01) AS a1, quantile_cont(a, 0.99) AS a2, quantile_cont(coalesce(q, qm), 0.01) AS q1, quantile_cont(coalesce(q, qm), 0.99) AS q2, max(qm) AS qm
            FROM (SELECT CAST(p_size * 3 AS DOUBLE) AS a, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS q FROM part),
              (SELECT quantile_cont(CAST(p_size % 5 AS DOUBLE), 0.5) AS qm FROM part WHERE p_partkey % 17 <> 0)))""",
    "ly", "ca", "cq",
)
_PARK = SCORES["score_parque"]


@query(
    f"""WITH {_HOMES2}, f AS (SELECT max(a1) AS a1, max(a2) AS a2, max(q1) AS q1, max(q2) AS q2 FROM t),
    h AS (SELECT c_custkey, abs(c_acctbal) / 20 AS area, CAST(c_custkey % 5 AS DOUBLE) AS q, {place_sql('c_custkey')} FROM customer
        WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 <> 0),
    parks AS (SELECT {place_sql('s_suppkey')} FROM supplier WHERE s_nationkey % 7 = {list(RADII).index('parque')}),
    d AS (SELECT c_custkey, 2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(s.lat - h.lat) / 2), 2)
        + cos(radians(h.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - h.lon) / 2), 2)))) AS metres FROM h CROSS JOIN parks s),
    w AS (SELECT c_custkey, min(metres) AS near, count(*) FILTER (metres <= {RADII['parque']}) AS parks_near FROM d GROUP BY 1)
    SELECT h.c_custkey, round(h.lat, 6) AS lat, round(h.lon, 6) AS lon, round({_PARK[1]}::double * exp(-near / {_PARK[2]}::double) + {_PARK[3]}::double * parks_near, 6) AS score_parque,
        round(b0 + b1 * least(greatest(h.area, a1), a2) + b2 * least(greatest(h.q, q1), q2), 5) AS log_preco
    FROM h LEFT JOIN w USING (c_custkey), b, f"""
)
def online_prices(spark, sf):
    """Coordinates, a score and the price of every new listing that resolves, by a model of two features."""
    new, cache, poi = _new_listings(spark, sf)
    rows = homes(spark, sf)
    model = fit_full(rows, LinearRegression(labelCol="log_preco", solver="normal"), "log_preco", ["area_m2", "quartos"], [])
    priced, _ = price_new_listings(new, cache, poi, model, "modelo", "1.0.0")
    return priced.select(
        "c_custkey", r("lat", 6).alias("lat"), r("lon", 6).alias("lon"), r("score_parque", 6).alias("score_parque"), r("log_preco", 5).alias("log_preco")
    )
