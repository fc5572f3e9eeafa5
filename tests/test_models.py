import itertools
import tempfile
from math import factorial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lotwise.operators import explain, models
from lotwise.operators.metrics import metrics_dict
from lotwise.operators.transformers import (
    ColumnScaler,
    DropFirstEncoder,
    FeatureAssembler,
    MedianImputer,
    ModeImputer,
    QuantileClipper,
    feature_names,
    fill_with_medians,
)
from lotwise.plans.prepare import NUM_FEATURES, prepare
from lotwise.plans.score import score
from lotwise.plans.train import fit_full, train
from lotwise.functions.scores import RADII, count_name, distance_name
from lotwise.sources.runs import load_model


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.3] + [0, 2, 1]
    y = 2 + x @ [1.5, -0.2, 3.0] + rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    vec = FeatureAssembler(numeric=["a", "b", "c"], text=[]).fit(df).transform(df).persist()
    return x, y, vec


def coordinate_descent(x, y, alpha, rho, turns=2000):
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            c = xc[:, j] @ r / n
            w[j] = np.sign(c) * max(abs(c) - alpha * rho, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - rho))
    return w


def test_linear_and_ridge(numbers):
    x, y, df = numbers
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(models.linear(df, "y").fit(df).coefficients, np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-8)
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    assert np.allclose(models.ridge(df, "y", 10.0).fit(df).coefficients, want, atol=1e-7)


@pytest.mark.parametrize("alpha,rho", [(0.1, 1.0), (0.3, 0.5), (0.001, 0.5)])
def test_lasso_and_elastic_net(numbers, alpha, rho):
    x, y, df = numbers
    got = models.elastic_net(df, "y", alpha, rho).fit(df).coefficients
    assert np.allclose(got, coordinate_descent(x, y, alpha, rho), atol=1e-6)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, prediction double")
    m = metrics_dict(df, "y")
    assert m["mse"] == pytest.approx(1.25 / 3) and m["mae"] == pytest.approx(0.5)
    assert m["r2"] == pytest.approx(1 - 1.25 / (14 / 3)) and m["mape"] == pytest.approx((0.5 + 0 + 0.25) / 3)


def test_imputer_clipper_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    filled = MedianImputer(["x"]).fit(df).transform(df)
    assert sorted(r["x"] for r in filled.collect()) == [1.0, 2.0, 2.5, 2.5, 3.0, 10.0]
    some = df.where("x is null or x < 100")
    clipped = QuantileClipper(["x"], 0.25, 0.75).fit(some).transform(some).collect()
    assert sorted(r["x"] for r in clipped if r["x"] is not None) == [1.75, 2.0, 3.0, 4.75]
    assert sum(r["x"] is None for r in clipped) == 1
    two = spark.createDataFrame([(1.0, 3.0), (3.0, 4.0)], "x double, z double")

    def scaled(kind, cols=("x",)):
        return [tuple(r) for r in ColumnScaler(list(cols), kind).fit(two).transform(two).select(*cols).orderBy(cols[0]).collect()]

    assert scaled("standard") == [(-1.0,), (1.0,)]
    assert scaled("min_max") == [(0.0,), (1.0,)]
    assert scaled("max_abs") == [(1 / 3,), (1.0,)]
    assert scaled("robust") == [(-1.0,), (1.0,)]
    assert scaled("none") == [(1.0,), (3.0,)]
    assert np.allclose(sorted(scaled("normalizer", ("x", "z"))), sorted([(1 / 10**0.5, 3 / 10**0.5), (0.6, 0.8)]))
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r["x"] for r in ColumnScaler(["x"]).fit(flat).transform(flat).collect()} == {0.0}


def test_wide_encoder_has_the_slots_of_the_narrow_one(spark, tmp_path):
    """Labels in a table instead of the fitted step: same vectors, also after saving, for nulls and unknown texts."""
    fit = spark.createDataFrame([(i, f"t{i * 37 % 501:03d}" if i % 9 else None) for i in range(900)], "id int, v string")
    more = spark.createDataFrame([(1, "t000"), (2, "t500"), (3, "new"), (4, None), (5, "t007")], "id int, v string")
    narrow = DropFirstEncoder(["v"]).fit(fit)
    wide = DropFirstEncoder(["v"], widest=10, folder=f"{tmp_path}/labels").fit(fit)
    path = f"{tmp_path}/model"
    wide.write().save(path)
    for rows in (fit, more):
        want = {r["id"]: r["v_onehot"] for r in narrow.transform(rows).collect()}
        for model in (wide, PipelineModel.load(path)):
            out = model.transform(rows)
            assert out.columns[:2] == ["id", "v"] and {r["id"]: r["v_onehot"] for r in out.collect()} == want
    assert feature_names(wide, [], ["v"]) == feature_names(narrow, [], ["v"])


def test_wide_encoder_names_no_slots_on_the_driver(spark, tmp_path):
    """The vector column's metadata holds the number of slots, whatever it is, and the assembler takes it."""
    fit = spark.createDataFrame([(float(i), f"t{i:05d}") for i in range(3000)], "x double, v string")
    out = (model := DropFirstEncoder(["v"], widest=10, folder=f"{tmp_path}/labels").fit(fit)).transform(fit)
    assert out.schema["v_onehot"].metadata == {"ml_attr": {"num_attrs": 2999}}
    assert model.stages[-1].categorySizes[0] - 1 == 2999
    both = FeatureAssembler(numeric=["x"], text=["v"]).fit(out).transform(out).where("x in (0, 7)").orderBy("x").collect()
    assert [r["features"] for r in both] == [Vectors.sparse(3000, {}), Vectors.sparse(3000, {0: 7.0, 7: 1.0})]


def test_encoder_drops_first_and_ignores_unknown(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "v string")
    model = DropFirstEncoder(["v"]).fit(fit)
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "v string")
    got = model.transform(rows).select("v", vector_to_array("v_onehot").alias("o")).collect()
    assert {r["v"]: r["o"] for r in got} == {"a": [0, 0], "b": [1, 0], "c": [0, 1], "z": [0, 0], None: [0, 0]}
    assert feature_names(model, ["n"], ["v"]) == ["n", "v_b", "v_c"]


def test_mode_imputer_quotes(spark):
    df = spark.createDataFrame([("d'Oeste",), ("d'Oeste",), ("a",), (None,)], "v string")
    assert sorted(r["v"] for r in ModeImputer(["v"]).fit(df).transform(df).collect()) == ["a", "d'Oeste", "d'Oeste", "d'Oeste"]


def test_fill_keeps_types(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (None, 4.0)], "i int, x double")
    out = fill_with_medians(df)
    assert out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(1, 1.0), (2, 2.5), (2, 4.0)]


def shap_by_subsets(nodes, x):
    """Shapley values straight from the definition, absent features averaged by cover."""
    def value(known, node=0):
        left, right, v, count, f, split, _ = nodes[node]
        if left < 0:
            return v
        if f in known:
            return value(known, left if x[f] <= split[0] else right)
        return sum(nodes[c][3] / count * value(known, c) for c in (left, right))

    k = len(x)
    out = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for size in range(k):
            for s in itertools.combinations(rest, size):
                w = factorial(size) * factorial(k - size - 1) / factorial(k)
                out[i] += w * (value({*s, i}) - value(set(s)))
    return out


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_tree_contributions(spark, numbers, kind):
    x, _, df = numbers
    estimator = (
        GBTRegressor(labelCol="y", maxIter=4, maxDepth=3) if kind == "boosted"
        else RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, featureSubsetStrategy="all", seed=1)
    )
    model = estimator.fit(df)
    out = explain.explain_trees(model, model.transform(df), ["a", "b", "c"]).orderBy("id").collect()
    trees = explain.tree_nodes(model, spark)
    for i in (0, 7, 100):
        want = sum(w * shap_by_subsets(n, x[i]) for w, n in trees)
        got = np.array([c["phi"] for c in out[i]["contributions"]])
        assert np.allclose(got, want, atol=1e-9)
        assert out[i]["base"] + got.sum() == pytest.approx(out[i]["prediction"], abs=1e-9)


def test_linear_contributions(numbers):
    x, _, df = numbers
    model = models.linear(df, "y").fit(df)
    out = explain.explain_linear(model, model.transform(df), ["a", "b", "c"])
    row = out.where("id = 3").first()
    phi = [c["phi"] for c in row["contributions"]]
    assert np.allclose(phi, model.coefficients.toArray() * (x[3] - x.mean(0)))
    assert row["base"] + sum(phi) == pytest.approx(row["prediction"])
    top = explain.local_explanation(out, ["id"], top=2).where("id = 3").orderBy("position").collect()
    assert [r["feature"] for r in top][-1] == "other" and len(top) == 3
    assert sum(r["phi"] for r in top) == pytest.approx(sum(phi))
    ranks = explain.global_importance(out).collect()
    assert [r["importance"] for r in ranks] == sorted((r["importance"] for r in ranks), reverse=True)
    assert explain.dependence(out, ["id"], "b").count() == 300


def homes(spark, n=400):
    k = F.col("id")
    rows = spark.range(n).select(
        k.alias("key"), F.element_at(F.array(*map(F.lit, ["Casa", "Cobertura", "Sala", "Lote"])), (k % 4 + 1).cast("int")).alias("tipo_imovel"),
        (k % 5).cast("double").alias("quartos"), (k % 3).cast("double").alias("banheiros"), (k % 2).cast("double").alias("vagas_garagem"),
        F.when(k % 9 != 0, (k * 37 % 450).cast("double")).alias("area_m2"),
        F.concat(F.lit("B"), (k % 6).cast("string")).alias("bairro"),
        (100_000 + (k * 37 % 450) * 900 + (k % 5) * 10_000).cast("double").alias("preco"),
        *[((k * 13 % 700) * 1.0).alias(distance_name(c)) for c in RADII], *[(k % 4).alias(count_name(c, r)) for c, r in RADII.items()],
    )
    return prepare(rows, fill=False)


def test_train_log_reload_score(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    table = homes(spark)
    trials = [{"n_estimators": 4, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.9, "colsample_bytree": 0.8}]
    result = train(table, ["key"], folder, trials=trials)
    assert set(result.metrics) == {"r2", "rmse", "mae", "mape", "mse"} == set(result.baseline)
    model = load_model(spark, folder, "prices")
    assert isinstance(model, PipelineModel)
    given = table.drop("log_preco", "faixa_area", "preco")
    out = score(model, given, model_name="m", version="1")
    again = score(result.model, given)
    assert out.count() == given.count()
    assert {"log_preco", "preco_estimado", "moeda", "modelo", "versao_modelo"} <= set(out.columns)
    a = {r["key"]: r["preco_estimado"] for r in out.collect()}
    assert a == {r["key"]: r["preco_estimado"] for r in again.collect()}
    assert load_model(spark, folder, run_id=result.run_id) is not None


def test_missing_scores_zero_or_imputed(spark):
    table = homes(spark)
    fitted = fit_full(table, models.linear(table, "log_preco"), "log_preco", NUM_FEATURES, ["bairro"])
    one = spark.createDataFrame([(1, 3.0, 2.0, 120.0, "B1")], "key int, quartos double, banheiros double, area_m2 double, bairro string")
    zero, imputed = (score(fitted, one, missing=m).first()["log_preco"] for m in ("zero", "impute"))
    explicit = one.withColumns({c: F.lit(0.0) for c in NUM_FEATURES if c not in one.columns})
    assert zero == pytest.approx(score(fitted, explicit).first()["log_preco"])
    assert zero != pytest.approx(imputed)


def test_trials_are_reproducible_and_in_range():
    trials = models.draw_trials(20)
    assert trials == models.draw_trials(20)
    for t in trials:
        for name, (low, high, _) in models.SEARCH_SPACE.items():
            assert low <= t[name] <= high


@pytest.mark.parametrize("width", [50, 5000])
def test_ridge_is_as_exact_with_many_features(spark, width):
    """The same solver and tolerance at any width, against the closed form."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(250, width))
    y = x[:, :5].sum(axis=1) + 3 + rng.normal(size=250)
    df = spark.createDataFrame([(Vectors.dense(r.tolist()), float(t)) for r, t in zip(x, y)], ["features", "y"])
    model = models.ridge(df, "y", alpha=20.0).fit(df)
    c = x - x.mean(axis=0)
    want = c.T @ np.linalg.solve(c @ c.T + 20.0 * np.eye(250), y - y.mean())
    assert np.abs(model.coefficients.toArray() - want).max() < 2e-6
    assert abs(model.intercept - (y.mean() - x.mean(axis=0) @ want)) < 2e-6


def test_rows_are_spread_before_explaining(spark):
    """Rows that lie in one task are dealt over several; a column of maps passes through."""
    rows = spark.range(0, 30_000, 1, 1).select(
        "id", F.create_map(F.lit("k"), F.col("id")).alias("m"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
    ).withColumn("y", F.col("a") * 2 + F.col("b"))
    data = FeatureAssembler(numeric=["a", "b"], text=[]).fit(rows).transform(rows)
    model = models.decision_tree(data, "y", 3).fit(data)
    out = explain.explain_trees(model, model.transform(data), ["a", "b"])
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("contributions").alias("n"), F.count("m").alias("maps")).collect()]
    assert len(sizes) >= 3 and max(sizes) <= 15_000 and sum(sizes) == 30_000
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["phi"])
    assert out.where(F.abs(total - F.col("prediction")) > 1e-9).count() == 0


def test_preprocessing_is_fitted_on_spread_rows(spark):
    """The rows are computed once for all passes of preprocessing and model, from one task into several."""
    read = spark.sparkContext.accumulator(0)

    def value(k):
        read.add(1)
        return float(k % 13)

    n = 25_000
    rows = spark.range(0, n, 1, 1).select(F.udf(value, "double")("id").alias("a"), (F.col("id") % 3).cast("string").alias("t"), F.col("id").cast("double").alias("y"))
    model = fit_full(rows, models.linear(rows, "y"), "y", ["a"], ["t"])
    assert read.value == n
    assert model.transform(rows).where("prediction is null").count() == 0


def test_comparison_rows_are_spread(spark):
    """Models are fitted over several tasks, though the rows come from one."""
    rows = spark.range(0, 60_000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    board = models.ModelComparison(rows, "y", ["a"], ["id"]).prepare()
    sizes = [r["n"] for r in board.train.groupBy(F.spark_partition_id()).agg(F.count("y").alias("n")).collect()]
    board.close()
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
