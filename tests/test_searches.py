"""Searches at their full size, and settings that grow in a task of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boosting import SETTING, data, slow_boost, table

from lotwise.operators import boosting, models
from lotwise.plans import train as train_plan
from lotwise.queries import QUERIES


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A part table of a few rows, gaps among them."""
    folder = str(tmp_path_factory.mktemp("parts"))
    k = F.col("id")
    spark.range(1, 61).select(
        k.alias("p_partkey"), F.concat(F.lit("Brand#"), (k % 4 + 1).cast("string")).alias("p_brand"),
        (k * 7 % 23 + 1).cast("int").alias("p_size"), F.when(k % 20 != 0, 900.0 + k).alias("p_retailprice"),
    ).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def whole(trials):
    return [{k: float(v) for k, v in t.items()} for t in trials] == [{k: float(v) for k, v in t.items()} for t in models.draw_trials(50)]


def test_param_search_runs_all_trials_over_the_full_ranges(spark, parts):
    board = QUERIES["param_search"](spark, parts).orderBy("trial").collect()
    assert [r["trial"] for r in board] == list(range(50)) and whole([r["params"] for r in board])
    trees = [r["params"]["n_estimators"] for r in board]
    assert min(trees) >= 200 and max(trees) > 700 and max(r["params"]["max_depth"] for r in board) == 10
    assert all(0 < r["rmse"] < 5 for r in board) and len({r["rmse"] for r in board}) > 40


def test_train_and_register_searches_the_full_ranges(spark, parts, monkeypatch):
    boards, search = [], train_plan.search

    def kept(*args):
        best, board = search(*args)
        boards.append(board.orderBy("trial").collect())
        return best, board

    monkeypatch.setattr(train_plan, "search", kept)
    out = {r["metric"]: r["value"] for r in QUERIES["train_and_register"](spark, parts).collect()}
    assert len(boards) == 1 and whole([r["params"] for r in boards[0]])
    assert out["scored_rows"] == 60 and {"rmse", "r2", "baseline_rmse"} <= set(out)


SETTINGS = [
    {**SETTING, "n_estimators": 12, "max_depth": 6, "subsample": 0.6, "colsample_bytree": 0.6, "reg_alpha": 0.0},
    SETTING,
    {**SETTING, "reg_alpha": 0.0, "reg_lambda": 0.0, "max_depth": 2, "n_estimators": 5},
    {**SETTING, "reg_alpha": 1e9},
]


def test_a_setting_grows_alone_as_by_passes(spark, monkeypatch):
    x, y = data()
    x[5, 2] = np.nan
    df = table(spark, x, [None, np.nan, *y[2:]]).repartition(3).persist()
    monkeypatch.setattr(boosting, "CHUNK", 100)  # sums of several chunks
    alone, passes = boosting.fit(df, "y", SETTINGS), boosting.grow(df, "y", SETTINGS)
    for a, b, s in zip(alone, passes, SETTINGS):
        a, b = a.plain(), b.plain()
        assert len(a["trees"]) == s["n_estimators"] and a["start"] == b["start"] and a["rate"] == b["rate"]
        for one, other in zip(a["trees"], b["trees"]):
            assert one[0] == other[0] and one[1] == other[1] and one[3] == other[3] and np.allclose(one[2], other[2], atol=1e-9)
    assert boosting.fit(df, "y", SETTINGS[:1])[0].plain() == alone[0].plain()
    df.unpersist()


def test_a_lone_setting_equals_numpy(spark):
    x, y = data()
    df = table(spark, x, y)
    for s, model in zip(SETTINGS[1:3], boosting.fit(df, "y", SETTINGS[1:3])):
        got = np.array([r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()])
        assert np.allclose(got, slow_boost(x, y, s), atol=1e-9)


def test_held_rows_are_scored_where_a_setting_grows(spark):
    """Held rows without a label take no part; values beyond the edges and missing ones go where the model sends them."""
    x, y = data()
    df = table(spark, x, y)
    other, t = data(90, seed=9)
    other[0, 0], other[1, 0], other[2, 2] = -1e9, 1e9, np.nan
    held = table(spark, other, [*t[:-1], None])
    scored = boosting.fit_and_score(df, held, "y", SETTINGS).collect()
    for i, model in enumerate(boosting.fit(df, "y", SETTINGS)):
        want = sorted((r["y"], r["prediction"]) for r in model.transform(held).where("y is not null").collect())
        assert np.allclose(sorted((r["y"], r["prediction"]) for r in scored if r["setting"] == i), want, atol=1e-12) and len(want) == 89


def test_rows_beyond_the_bound_are_not_gathered(spark, monkeypatch):
    x, y = data(80)
    df, passes = table(spark, x, y), []
    plain = boosting.gradient_sums
    monkeypatch.setattr(boosting, "gradient_sums", lambda *a: passes.append(1) or plain(*a))
    near = boosting.fit(df, "y", [SETTING])[0].plain()
    assert not passes
    monkeypatch.setattr(boosting, "GATHER_BYTES", 80 * (4 + 16) - 1)
    assert boosting.fit(df, "y", [SETTING])[0].plain()["trees"][0][0] == near["trees"][0][0] and len(passes) == 9
    assert boosting.fit_and_score(df, df, "y", [SETTING]) is None


def test_search_scores_alike_with_and_without_the_bound(spark, monkeypatch):
    rows = spark.range(240).select(
        "id", (F.col("id") * 37 % 50).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("t"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 50) * 2.0 + F.col("id") % 3).alias("y"),
    )
    trials = [{"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3}, {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1, "subsample": 0.5}]
    best, board = models.search(rows, "y", ["a"], ["t"], ["id"], trials)
    monkeypatch.setattr(boosting, "GATHER_BYTES", 0)
    again, other = models.search(rows, "y", ["a"], ["t"], ["id"], trials)
    assert best == again == trials[0]
    assert [(r["trial"], pytest.approx(r["rmse"])) for r in board.collect()] == [(r["trial"], r["rmse"]) for r in other.collect()]


def test_nothing_to_fit_or_to_score(spark):
    x, y = data(40)
    df = table(spark, x, y)
    assert boosting.fit(df.limit(0), "y", [SETTING])[0].transform(df).where("prediction is not null").count() == 0
    assert boosting.fit_and_score(df.where("y is null"), df, "y", [SETTING]) is None
    assert boosting.fit_and_score(df, df.limit(0), "y", [SETTING]).count() == 0
    flat = table(spark, np.ones((5, 2)), np.full(5, 2.0))
    assert {r["prediction"] for r in boosting.fit_and_score(flat, flat, "y", [SETTING]).collect()} == {2.0}
