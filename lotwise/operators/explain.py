"""Additive contributions of features to predictions."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.operators.boosting import BoostedTrees
from lotwise.session import shared_folder, spread


def contribution_array(names: list[str], values: Column, phi: Column) -> Column:
    """Array of (feature, value, phi) from two aligned arrays."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.transform(
        F.arrays_zip(labels.alias("feature"), values.alias("value"), phi.alias("phi")),
        lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["phi"].alias("phi")),
    )


def linear_terms(df: DataFrame, features: list[str], slopes: list[float], intercept: float) -> DataFrame:
    """Rows with `base` and `contributions`, w_j*(x_j - mean_j), from plain columns."""
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    base = intercept + sum(w * means[f] for f, w in zip(features, slopes))
    terms = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(f) - F.lit(means[f]))).alias("phi"),
        )
        for f, w in zip(features, slopes)
    ]
    return df.withColumns({"base": F.lit(float(base)), "contributions": F.array(*terms)})


def explain_linear(model: LinearRegressionModel, df: DataFrame, names: list[str]) -> DataFrame:
    """The same for a fitted linear model and its feature vector."""
    mean = np.asarray(df.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray())
    w = model.coefficients.toArray()
    x = vector_to_array("features")
    phi = F.zip_with(
        F.zip_with(x, F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b),
        F.array(*[F.lit(float(v)) for v in w]),
        lambda a, b: a * b,
    )
    return df.withColumns(
        {"base": F.lit(float(model.intercept + w @ mean)), "contributions": contribution_array(names, x, phi)}
    )


def tree_nodes(model, spark) -> list[tuple[float, dict]]:
    """(weight, nodes by id) per tree, read from the saved form of a tree model; as many rows as the model has nodes, that
    is 2^(depth + 1) for a tree at most, which the driver held when it fitted the model."""
    if isinstance(model, BoostedTrees):
        plain = model.plain()
        trees = [
            (plain["rate"], {i: (left, right, value, rows, f, [cut], -1) for i, (left, right, value, rows, f, cut) in nodes.items()})
            for nodes in model.heaps()
        ]
        return [(1.0, {0: (-1, -1, plain["start"], 1.0, -1, [], -1)}), *trees]
    path = shared_folder(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()
        meta = spark.read.parquet(f"{path}/treesMetadata")
        weights = {r[0]: r[2] for r in meta.collect()}
        if hasattr(model, "getNumTrees") and type(model).__name__.startswith("RandomForest"):
            weights = {k: 1.0 / len(weights) for k in weights}
    else:
        rows = data.select(F.lit(0).alias("treeID"), "*").collect()
        weights = {0: 1.0}
    trees: dict[int, dict] = {k: {} for k in weights}
    for r in rows:
        split = r["split"]
        trees[r["treeID"]][r["id"]] = (
            r["leftChild"], r["rightChild"], r["prediction"], float(r["rawCount"]),
            split["featureIndex"], list(split["leftCategoriesOrThreshold"]), split["numCategories"],
        )
    return [(weights[k], trees[k]) for k in sorted(weights)]


def leaf_conditions(nodes: dict) -> list[tuple[float, list]]:
    """Per leaf its value and, per feature on the way, (feature, low, high, values, share of rows)."""
    leaves = []

    def walk(node: int, seen: dict):
        left, right, value, count, feature, split, categories = nodes[node]
        if left < 0:
            leaves.append((value, [(f, *c) for f, c in seen.items()]))
            return
        for child, goes_left in ((left, True), (right, False)):
            low, high, allowed, share = seen.get(feature, (-np.inf, np.inf, None, 1.0))
            if categories >= 0:
                own = set(split) if goes_left else {float(v) for v in range(categories)} - set(split)
                allowed = own if allowed is None else allowed & own
            elif goes_left:
                high = min(high, split[0])
            else:
                low = max(low, split[0])
            walk(child, {**seen, feature: (low, high, allowed, share * nodes[child][3] / count)})

    walk(0, {})
    return leaves


def shapley_rows(x: np.ndarray, trees: list[tuple[float, list]]) -> np.ndarray:
    """Contributions per row and feature: per leaf, the share of feature orders in which a feature turns the leaf on or
    off, absent features weighted by the training rows' split.

    A leaf's conditions are factors (share + inside * z) of one polynomial; dividing it by a feature's own factor leaves
    the orders of the others, so a leaf of k conditions costs k * k steps.
    """
    out = np.zeros_like(x)
    for weight, leaves in trees:
        for value, conditions in leaves:
            k = len(conditions)
            if k == 0:
                continue
            inside = []
            for f, low, high, allowed, _ in conditions:
                ok = ~(x[:, f] <= low) & ((x[:, f] <= high) | (high == np.inf))  # not a number: right of every cut
                if allowed is not None:
                    ok &= np.isin(x[:, f], list(allowed))
                inside.append(ok.astype(float))
            orders = [factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)]
            whole = np.zeros((k + 1, len(x)))
            whole[0] = 1.0
            for (*_, share), here in zip(conditions, inside):
                whole[1:] = whole[1:] * share + whole[:-1] * here
                whole[0] = whole[0] * share
            for (f, *_, share), here in zip(conditions, inside):
                rest, total = np.zeros(len(x)), np.zeros(len(x))
                for s in range(k - 1, -1, -1):  # from the highest power, which divides without growing errors
                    rest = np.where(here > 0, whole[s + 1] - share * rest, whole[s] / share)
                    total += orders[s] * rest
                out[:, f] += weight * value * (here - share) * total
    return out


def expected_value(nodes: dict) -> float:
    total = nodes[0][3]
    return sum(v[2] * v[3] / total for v in nodes.values() if v[0] < 0)


def explain_trees(model, df: DataFrame, names: list[str]) -> DataFrame:
    """`base` and `contributions` for a fitted tree, forest or boosted model, in Arrow batches. A row costs far more time than
    its bytes tell, so rows are spread first."""
    df = spread(df)
    trees = tree_nodes(model, df.sparkSession)
    base = float(sum(w * expected_value(n) for w, n in trees))
    shared = df.sparkSession.sparkContext.broadcast([(w, leaf_conditions(n)) for w, n in trees])

    @F.pandas_udf("array<double>")
    def phi(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(shapley_rows(np.stack(vectors.to_numpy()).astype(float), shared.value)))

    x = vector_to_array("features")
    return (
        df.withColumns({"_x": x, "base": F.lit(base)})
        .withColumn("_phi", phi("_x"))
        .withColumn("contributions", contribution_array(names, F.col("_x"), F.col("_phi")))
        .drop("_x", "_phi")
    )


def contribution_table(explained: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (keys, feature, value, phi)."""
    return explained.select(*keys, F.explode("contributions").alias("c")).select(*keys, "c.*")


def global_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    long = contribution_table(explained, [])
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def dependence(explained: DataFrame, keys: list[str], feature: str) -> DataFrame:
    return contribution_table(explained, keys).where(F.col("feature") == feature)


def local_explanation(explained: DataFrame, keys: list[str], top: int = 15) -> DataFrame:
    """Per row the largest contributions by size and the sum of the rest as 'other'.

    Sorted inside the row's own array, so nothing is shuffled.
    """
    by_size = F.array_sort(
        "contributions",
        lambda a, b: F.when(F.abs(a["phi"]) > F.abs(b["phi"]), F.lit(-1))
        .when(F.abs(a["phi"]) < F.abs(b["phi"]), F.lit(1))
        .when(a["feature"] < b["feature"], F.lit(-1))
        .otherwise(F.lit(1)),
    )
    ranked = explained.select(*keys, "base", by_size.alias("_all"))
    rest = F.aggregate(
        F.slice("_all", F.lit(top + 1), F.greatest(F.size("_all") - top, F.lit(0))),
        F.lit(0.0),
        lambda acc, c: acc + c["phi"],
    )
    other = F.struct(F.lit("other").alias("feature"), F.lit(None).cast("double").alias("value"), rest.alias("phi"))
    shown = F.when(
        F.size("_all") > top, F.concat(F.slice("_all", 1, top), F.array(other))
    ).otherwise(F.col("_all"))
    return ranked.select(*keys, "base", F.posexplode(shown).alias("_pos", "c")).select(
        *keys, "base", (F.col("_pos") + 1).alias("position"), "c.*"
    )
