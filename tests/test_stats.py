import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import stats
from lotwise.operators.distributions import f_tail, t_two_sided


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], schema)


def dummies(levels):
    return np.column_stack([[v == u for v in levels] for u in sorted(set(levels))]).astype(float)


def sse(x, y):
    return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    rows = []
    for a, b in itertools.product("xyz", "pqrs"):
        if (a, b) == ("y", "r"):
            continue
        n = int(rng.integers(1, 9))
        rows += [(a, b, float(v)) for v in rng.normal(ord(a) % 3 + ord(b) % 4, 1, n)]
    return rows


@pytest.mark.parametrize("interaction", [False, True])
def test_two_way_with_empty_cell(spark, table, interaction):
    a, b, y = ([r[i] for r in table] for i in range(3))
    y = np.array(y)
    da, db, one = dummies(a), dummies(b), np.ones((len(y), 1))
    cells = dummies([p + q for p, q in zip(a, b)])
    add = np.hstack([one, da, db])
    ss = {"a": sse(np.hstack([one, db]), y) - sse(add, y), "b": sse(np.hstack([one, da]), y) - sse(add, y),
          "a:b": sse(add, y) - sse(cells, y)}
    error = sse(cells, y) if interaction else sse(add, y)
    error_df = len(y) - np.linalg.matrix_rank(cells if interaction else add)
    got = {r["term"]: r for r in stats.anova_two_way(frame(spark, table, "a string, b string, y double"), "y", "a", "b", interaction).collect()}
    for term in ["a", "b"] + (["a:b"] if interaction else []):
        assert got[term]["sum_sq"] == pytest.approx(ss[term], abs=1e-9)
    assert got["residual"]["sum_sq"] == pytest.approx(error) and got["residual"]["df"] == error_df
    assert (got["a"]["df"], got["b"]["df"]) == (2, 3)
    if interaction:
        assert got["a:b"]["df"] == 5


def test_two_way_with_many_levels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), "pq"[int(j)], float(i % 7 + 2 * j + e)) for i, j, e in zip(rng.integers(0, 60, 900), rng.integers(0, 2, 900), rng.normal(0, 1, 900))]
    rows += [(None, "p", 1.0), (3, None, 1.0), (4, "q", float("nan"))]
    df = spark.createDataFrame(rows, "a long, b string, y double")
    full = [r for r in rows if None not in r and r[2] == r[2]]
    y, one = np.array([r[2] for r in full]), np.ones((len(full), 1))
    da, db = dummies([r[0] for r in full]), dummies([r[1] for r in full])
    add = sse(np.hstack([one, da, db]), y)
    monkeypatch.setattr(stats, "MAX_LEVELS", 2)
    for first, second in (("a", "b"), ("b", "a")):
        got = {r["term"]: r["sum_sq"] for r in stats.anova_two_way(df, "y", first, second).collect()}
        want = {"a": sse(np.hstack([one, db]), y) - add, "b": sse(np.hstack([one, da]), y) - add, "residual": add}
        assert got == pytest.approx(want)
    monkeypatch.setattr(stats, "MAX_LEVELS", 1)
    with pytest.raises(ValueError, match="at most 1 levels"):
        stats.anova_two_way(df, "y", "a", "b")


def test_two_way_without_rows(spark):
    got = stats.anova_two_way(spark.createDataFrame([], "a long, b string, y double"), "y", "a", "b", True).collect()
    assert [r["term"] for r in got] == ["a", "b", "a:b", "residual"] and all(r["sum_sq"] == 0 for r in got)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_one_way_and_levene(spark, table, request, limit):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    df = frame(spark, table + [("solo", "p", 3.0)], "a string, b string, y double")
    groups = {}
    for a, _, y in table + [("solo", "p", 3.0)]:
        groups.setdefault(a, []).append(y)

    def f_of(gs):
        every = np.concatenate(gs)
        between = sum(len(g) * (np.mean(g) - every.mean()) ** 2 for g in gs)
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in gs)
        return (between / (len(gs) - 1)) / (within / (len(every) - len(gs)))

    got = stats.anova_one_way(df, "y", "a").where("term = 'a'").first()
    assert got["F"] == pytest.approx(f_of(list(groups.values())))
    assert got["p"] == pytest.approx(f_tail(got["F"], got["df"], len(table) + 1 - 4))
    lev = stats.levene(df, "y", "a").first()
    assert lev["W"] == pytest.approx(f_of([np.abs(np.array(g) - np.median(g)) for g in groups.values()]))


def test_tails():
    assert f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert f_tail(1.0, 7, 7) == pytest.approx(0.5, abs=1e-12)
    assert t_two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)


def test_shapiro_published_example():
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.001)
    rng = np.random.default_rng(0)
    assert stats.shapiro_wilk(rng.normal(size=2000).tolist())[1] > 0.01
    assert stats.shapiro_wilk(rng.exponential(size=2000).tolist())[1] < 1e-6


def test_vif(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0]
    df = frame(spark, x.tolist(), "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in stats.vif(df, ["a", "b", "c"]).collect()}
    full = np.column_stack([np.ones(200), x])
    for j, name in enumerate(["const", "a", "b", "c"]):
        rest = np.delete(full, j, axis=1)
        target = full[:, j]
        total = (target**2).sum() if j == 0 else ((target - target.mean()) ** 2).sum()
        assert got[name] == pytest.approx(total / sse(rest, target), rel=1e-8)
    twin = df.withColumn("c", F.col("a") * 2)
    assert math.isinf({r["feature"]: r["vif"] for r in stats.vif(twin, ["a", "b", "c"]).collect()}["a"])


def test_least_squares_inference(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=80)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id int, a double, b double, y double")
    fit = stats.LinearFit(df, "y", ["a", "b"])
    full = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    e = y - full @ beta
    s2 = (e @ e) / 77
    se = np.sqrt(np.diag(s2 * np.linalg.inv(full.T @ full)))
    rows = fit.coefficients().collect()
    assert np.allclose([r["coef"] for r in rows], beta) and np.allclose([r["std_err"] for r in rows], se)
    s = fit.summary(order="id").first()
    assert s["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    assert s["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    assert s["kurtosis"] == pytest.approx((e**4).mean() / (e**2).mean() ** 2)
    assert fit.effects().where("term = 'a'").first()["effect"] == pytest.approx(math.exp(beta[1]) - 1)


def test_group_residuals_with_hot_group(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 1.0).alias("y"))
    out = stats.group_residuals(df, "y", "g")
    assert out.count() == 9000
    assert out.groupBy("g").agg(F.abs(F.avg("residual")).alias("m")).agg(F.max("m")).first()[0] < 1e-9


def test_durbin_watson_keeps_long_and_text_keys_apart(spark):
    rows = spark.range(2000).select("id", (F.col("id") + F.lit(1 << 60)).alias("far"), F.sin(F.col("id") / 50).alias("e"))
    rows = rows.withColumn("word", F.lpad(F.col("id").cast("string"), 6, "0")).repartition(7, F.rand(3))
    found = [stats.durbin_watson(rows, "e", k).first()[0] for k in ("id", "far", "word")]
    assert found[0] == pytest.approx(found[1], rel=1e-9) == pytest.approx(found[2], rel=1e-9) and found[0] < 0.01


def test_normality_refuses_larger_samples(spark):
    with pytest.raises(ValueError, match="5,000"):
        stats.normality(spark.range(10).select("id", F.col("id").cast("double").alias("x")), "x", ["id"], sample=6000)
