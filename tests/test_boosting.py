"""Penalised boosting against a plain numpy version, and its edges."""

import pickle
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from lotwise.operators import boosting, explain, models
from lotwise.session import spread

SETTING = {
    "n_estimators": 3, "learning_rate": 0.4, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 2.0,
    "reg_lambda": 5.0, "seed": 1,
}


def table(spark, x, y):
    rows = [(i, Vectors.dense([float(v) for v in r]), None if t is None else float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType()),
    ]))


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0.0)


def slow_boost(x, y, s):
    """Predictions of exact greedy trees with penalised leaves."""
    pred = np.full(len(y), y.mean())
    for _ in range(s["n_estimators"]):
        g = pred - y
        step = np.zeros(len(y))

        def grow(rows, depth):
            score = lambda r: soft(g[r].sum(), s["reg_alpha"]) ** 2 / (r.sum() + s["reg_lambda"])
            best = (0.0, None)
            if depth < s["max_depth"]:
                for f in range(x.shape[1]):
                    for cut in np.unique(x[rows, f])[:-1]:
                        left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -soft(g[rows].sum(), s["reg_alpha"]) / (rows.sum() + s["reg_lambda"])
            else:
                for side in best[1]:
                    grow(side, depth + 1)

        grow(np.ones(len(y), bool), 0)
        pred = pred + s["learning_rate"] * step
    return pred


def data(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 40, n), rng.integers(0, 3, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)]).astype(float)
    return x, 3 * x[:, 0] / 10 + x[:, 1] * x[:, 3] + np.sin(x[:, 2]) + rng.normal(size=n) / 5


def test_trees_equal_numpy_and_settings_grow_side_by_side(spark):
    x, y = data()
    df = table(spark, x, y)
    settings = [
        SETTING, {**SETTING, "reg_alpha": 0.0, "reg_lambda": 0.0, "max_depth": 2, "n_estimators": 5},
        {**SETTING, "reg_alpha": 30.0, "max_depth": 1, "n_estimators": 2},
    ]
    fitted = boosting.grow(df.repartition(4), "y", settings)
    for s, model in zip(settings, fitted):
        got = np.array([r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()])
        assert np.allclose(got, slow_boost(x, y, s), atol=1e-9)
        assert len(model.heaps()) == s["n_estimators"]
        assert all(nodes[0][3] == len(y) for nodes in model.heaps())


def test_predictions_written_between_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_TREES", 2)
    x, y = data(120)
    s = {**SETTING, "n_estimators": 7, "max_depth": 2}
    df = table(spark, x, y)
    got = np.array([r[0] for r in boosting.grow(df, "y", [s, {**s, "n_estimators": 3}])[0].transform(df).orderBy("id").select("prediction").collect()])
    assert np.allclose(got, slow_boost(x, y, s), atol=1e-9)


def test_row_and_column_shares(spark):
    x, y = data(2000)
    s = {**SETTING, "subsample": 0.5, "colsample_bytree": 0.5, "n_estimators": 6, "max_depth": 2, "reg_alpha": 0.0}
    first, again = (boosting.grow(table(spark, x, y), "y", [s])[0].plain() for _ in range(2))
    assert first == again
    for feature, _, _, rows in first["trees"]:
        assert 800 < rows[0] < 1200  # about half of the rows
        assert len({f for f in feature if f >= 0}) <= 2  # half of the columns


def test_many_values_are_binned(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    y = np.where(x[:, 0] > 0.3, 5.0, 1.0)
    edges = boosting.bin_edges(table(spark, x, y), "features", 64)
    assert all(30 < len(e) < 64 and e == sorted(e) for e in edges)
    model = models.penalised_boosting(None, "y", n_estimators=40, learning_rate=0.3, max_depth=2, subsample=1.0, colsample_bytree=1.0).fit(table(spark, x, y))
    errors = [abs(r["prediction"] - r["y"]) for r in model.transform(table(spark, x, y)).collect()]
    assert np.mean(errors) < 0.1


def test_saved_with_its_pipeline_and_explained(spark):
    x, y = data(150)
    df = table(spark, x, y)
    model = PipelineModel([boosting.grow(df, "y", [SETTING])[0]])
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/model"
    model.write().save(path)
    want = [r["prediction"] for r in model.transform(df).orderBy("id").collect()]
    assert [r["prediction"] for r in PipelineModel.load(path).transform(df).orderBy("id").collect()] == want
    out = explain.explain_trees(model.stages[0], model.transform(df), ["a", "b", "c", "d"])
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda acc, c: acc + c["phi"])
    assert out.agg(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-9


def test_edges(spark):
    x, y = data(40)
    nothing = boosting.grow(table(spark, x, y).limit(0), "y", [SETTING])[0]
    assert nothing.transform(table(spark, x[:2], y[:2])).where("prediction is not null").count() == 0
    x[3, 2] = np.nan  # belongs to the last bin
    gaps = table(spark, x, [None, *y[1:]])  # a row without a label is left out
    model = boosting.grow(gaps, "y", [SETTING])[0]
    assert model.heaps()[0][0][3] == 39
    assert model.transform(gaps).where("prediction is null or isnan(prediction)").count() == 0
    flat = boosting.grow(table(spark, np.ones((5, 2)), np.full(5, 2.0)), "y", [SETTING])[0]
    assert {r["prediction"] for r in flat.transform(table(spark, np.ones((5, 2)), np.full(5, 2.0))).collect()} == {2.0}
    with pytest.raises(ValueError):
        boosting.grow(gaps, "y", [SETTING], max_bins=1000)


def test_broadcasts_carry_no_class_of_the_package():
    """Executors have no copy of it."""
    growth = boosting.Growth(0, {**SETTING, "n_estimators": 2}, 2)
    growth.take([{"node": 0, "G": -3.0, "N": 6.0, "feature": 1, "bin": 0, "gl": -2.0, "nl": 2.0}])
    growth.take([])
    assert len(growth.trees) == 1 and b"lotwise" not in pickle.dumps((growth.task(), growth.waiting()))


def test_predictions_are_written_before_they_are_dear(spark, monkeypatch):
    """Many rows do not walk through all the trees of a setting with every pass."""
    x, y = data(120)
    df = table(spark, x, y)
    s = {**SETTING, "n_estimators": 4, "max_depth": 2}
    written, plain = [], boosting._advanced
    monkeypatch.setattr(boosting, "WRITE_WORK", 100)
    monkeypatch.setattr(boosting, "_advanced", lambda *a: written.append(1) or plain(*a))
    model = boosting.grow(df, "y", [s, {**s, "max_depth": 1}])[0]
    assert len(written) >= 2
    got = np.array([r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()])
    assert np.allclose(got, slow_boost(x, y, s), atol=1e-9)


def test_many_rows_of_one_task_are_spread(spark):
    rows = spark.range(0, 45_000, 1, 1).withColumn("x", F.rand(1))
    out = spread(rows)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 12_000
    assert out.agg(F.sum("x"), F.count("id")).first() == pytest.approx(rows.agg(F.sum("x"), F.count("id")).first())
    few = spark.range(0, 9_000, 1, 1)
    assert spread(few) is few and spread(out) is out and spread(few.limit(0)).count() == 0
