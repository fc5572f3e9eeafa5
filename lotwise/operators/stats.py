"""Tests and linear-model inference: sums on the cluster, algebra on small matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from lotwise.functions.numeric import nan_to_null
from lotwise.operators.distributions import f_tail, t_two_sided
from lotwise.operators.quantiles import beside_groups, grouped_quantiles
from lotwise.operators.sampling import stable_sample
from lotwise.session import cut_lineage


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and population covariances over rows complete in `cols`, in one pass."""
    rows = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    k = len(cols)
    pairs = list(combinations(range(k), 2))
    r = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)],
        *[F.var_pop(f"c{i}").alias(f"v{i}") for i in range(k)],
        *[F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    cov = np.diag([r[f"v{i}"] for i in range(k)]).astype(float)
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"s{i}_{j}"]
    return r["n"], np.array([r[f"m{i}"] for i in range(k)], dtype=float), cov


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation per feature and for the constant, largest first; collinear gives infinity."""
    _, mean, cov = moments(df, cols)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    rows = []
    for j, c in enumerate(cols):
        rest = [i for i in range(len(cols)) if i != j]
        r2 = float(corr[j, rest] @ np.linalg.lstsq(corr[np.ix_(rest, rest)], corr[rest, j], rcond=None)[0])
        rows.append((c, 1.0 / (1.0 - r2) if 1.0 - r2 > 1e-12 else float("inf")))
    rows.append(("const", 1.0 + float(mean @ np.linalg.pinv(cov) @ mean)))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").orderBy(F.desc("vif"), "feature")


def _cells(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    v = nan_to_null(F.col(y).cast("double"))
    rows = df.select(*by, v.alias("_y")).dropna()
    return rows.groupBy(*by).agg(
        F.count("_y").alias("n"), F.avg("_y").alias("mean"), (F.var_pop("_y") * F.count("_y")).alias("ss")
    )


@F.pandas_udf(DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(a, b, c) for a, b, c in zip(f, d1, d2)])


def anova_one_way(df: DataFrame, y: str, group: str, p_value: bool = True) -> DataFrame:
    """Rows (term, sum_sq, df, F, p) for the group and the residual."""
    g = _cells(df, y, [group])
    centre = g.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m")).scalar()
    off = F.col("mean") - centre
    t = g.agg(
        F.sum(F.col("n") * off * off).alias("ssb"),
        F.sum("ss").alias("ssw"),
        (F.count(F.lit(1)) - 1).cast("double").alias("d1"),
        (F.sum("n") - F.count(F.lit(1))).cast("double").alias("d2"),
    ).withColumn("F", F.try_divide(F.col("ssb") / F.col("d1"), F.col("ssw") / F.col("d2")))
    t = t.withColumn("p", _f_tail("F", "d1", "d2") if p_value else F.lit(None).cast("double"))
    none = F.lit(None).cast("double")
    terms = F.array(
        F.struct(
            F.lit(group).alias("term"), F.col("ssb").alias("sum_sq"), F.col("d1").alias("df"),
            F.col("F").alias("F"), F.col("p").alias("p"),
        ),
        F.struct(
            F.lit("residual").alias("term"), F.col("ssw").alias("sum_sq"), F.col("d2").alias("df"),
            none.alias("F"), none.alias("p"),
        ),
    )
    return t.select(F.explode(terms).alias("r")).select("r.*")


MAX_LEVELS = 1000  # levels of the smaller factor of a two-way analysis: its square is what one task holds


def _overlaps(cells: DataFrame, wide: str, width: int) -> np.ndarray:
    """Sum over the levels of `wide` of the outer product of their cell counts, divided by the level's count.

    A level has at most `width` cells (column _k numbers them), a task keeps one width x width sum.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            for ks, ns in zip(pdf["ks"], pdf["ns"]):
                v = np.zeros(width)
                v[np.asarray(ks)] = ns
                total += np.outer(v, v) / v.sum()
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    pairs = cells.select(wide, F.struct("_k", "n").alias("c")).groupBy(wide).agg(F.collect_list("c").alias("c"))
    parts = pairs.select(F.col("c._k").alias("ks"), F.col("c.n").alias("ns")).mapInPandas(run, "i long, j long, v double")
    out = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():  # at most width x width rows
        out[i, j] = v
    return out


def _additive_sse(cells: DataFrame, levels: dict[str, DataFrame], wide: str, narrow: str) -> tuple[float, int]:
    """Weighted residual sum of cell means around the additive fit, and the rank of its narrow part.

    The wide factor is eliminated level by level, so the system that is solved is as wide as the narrow one.
    """
    known = [(r[narrow], k, float(r["n"])) for k, r in enumerate(levels[narrow].orderBy(narrow).collect())]
    if not known:
        return 0.0, 0
    kind = cells.schema[narrow].dataType.simpleString()
    places = cells.sparkSession.createDataFrame([x[:2] for x in known], f"{narrow} {kind}, _k int")
    around = levels[wide].select(wide, F.col("n").alias("_n"), F.col("mean").alias("_m"))
    placed = cut_lineage(cells.join(F.broadcast(places), narrow).join(around, wide), "cells")  # MAX_LEVELS rows
    system = np.diag([x[2] for x in known]) - _overlaps(placed, wide, len(known))
    right = np.zeros(len(known))
    for k, v in placed.groupBy("_k").agg(F.sum(F.col("n") * (F.col("mean") - F.col("_m")))).collect():
        right[k] = v
    beta = np.linalg.pinv(system, hermitian=True) @ right
    effects = cells.sparkSession.createDataFrame(list(enumerate(beta.tolist())), "_k int, _beta double")
    rest = placed.join(F.broadcast(effects), "_k").withColumn("_e", F.col("mean") - F.col("_m") - F.col("_beta"))
    own = rest.groupBy(wide).agg((F.sum(F.col("n") * F.col("_e")) / F.sum("n")).alias("_own"))
    gap = F.col("_e") - F.col("_own")
    spread = rest.join(own, wide).agg(F.sum(F.col("n") * gap * gap)).first()[0]
    return float(spread), int(np.linalg.matrix_rank(system, hermitian=True))


def anova_two_way(df: DataFrame, y: str, a: str, b: str, interaction: bool = False) -> DataFrame:
    """Type II sums of squares from the cell counts and means; empty cells are allowed.

    Cells stay on the cluster; one factor may have any number of levels, the other at most MAX_LEVELS, because a
    matrix as wide as its levels is solved on the driver.
    """
    cells = _cells(df, y, [a, b]).select(F.col(a).alias("_a"), F.col(b).alias("_b"), "n", "mean", "ss")
    cells = cut_lineage(cells, "cells")
    mean = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")
    levels = {k: cut_lineage(cells.groupBy(k).agg(F.sum("n").alias("n"), mean), "levels") for k in ("_a", "_b")}
    count = {k: levels[k].count() for k in levels}
    if min(count.values()) > MAX_LEVELS:
        raise ValueError(f"one of the two factors may have at most {MAX_LEVELS} levels")
    wide, narrow = ("_a", "_b") if count["_a"] >= count["_b"] else ("_b", "_a")
    whole = cells.agg(F.sum("ss").alias("ss"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).first()
    ssw, total, rank_cells = whole["ss"] or 0.0, whole["n"] or 0, whole["cells"]

    def one_factor(key: str) -> float:
        off = F.col("mean") - F.col("_m")
        beside = cells.join(levels[key].select(key, F.col("mean").alias("_m")), key)
        return ssw + (beside.agg(F.sum(F.col("n") * off * off)).first()[0] or 0.0)

    spread, rank = _additive_sse(cells, levels, wide, narrow)
    rank += count[wide]
    additive, only_a, only_b = ssw + spread, one_factor("_a"), one_factor("_b")
    terms = [(a, only_b - additive, rank - count["_b"]), (b, only_a - additive, rank - count["_a"])]
    if interaction:
        terms.append((f"{a}:{b}", additive - ssw, rank_cells - rank))
        error, error_df = ssw, total - rank_cells
    else:
        error, error_df = additive, total - rank
    rows = []
    for name, ss, d in terms:
        f = (ss / d) / (error / error_df) if d > 0 and error > 0 and error_df > 0 else float("nan")
        rows.append((name, ss, float(d), f, f_tail(f, d, error_df) if d > 0 else float("nan")))
    rows.append(("residual", error, float(error_df), None, None))
    return df.sparkSession.createDataFrame(rows, "term string, sum_sq double, df double, F double, p double")


def levene(df: DataFrame, y: str, group: str, p_value: bool = True) -> DataFrame:
    """One-way analysis of absolute deviations from the group medians: (W, p, df1, df2)."""
    rows = df.select(group, nan_to_null(F.col(y).cast("double")).alias("_y")).dropna()
    med = grouped_quantiles(rows, [group], "_y", [0.5]).select(group, "n", F.col("q0").alias("_m"))
    z = beside_groups(rows, cut_lineage(med, "medians"), [group]).select(group, F.abs(F.col("_y") - F.col("_m")).alias("_z"))
    table = anova_one_way(z, "_z", group, p_value)
    return table.agg(
        F.max("F").alias("W"),
        F.max("p").alias("p"),
        F.max(F.when(F.col("term") == group, F.col("df"))).alias("df1"),
        F.max(F.when(F.col("term") != group, F.col("df"))).alias("df2"),
    )


def group_residuals(df: DataFrame, y: str, group: str) -> DataFrame:
    """Rows with `residual`, the distance of y from its group mean."""
    rows = df.where(F.col(group).isNotNull())
    means = rows.groupBy(group).agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("n"))
    joined = beside_groups(rows, cut_lineage(means, "means"), [group])
    return joined.select(*df.columns, (F.col(y) - F.col("_mean")).alias("residual"))


def jarque_bera(df: DataFrame, col: str) -> DataFrame:
    """n, skewness, kurtosis (3 for a normal), statistic and p from one aggregate."""
    x = nan_to_null(F.col(col).cast("double"))
    m = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + (F.col("kurtosis") - 3) ** 2 / 4)
    return m.withColumn("jarque_bera", jb).withColumn("p", F.exp(-F.col("jarque_bera") / 2))


# Royston's polynomials for the W test (lowest power first).
_ROYSTON_A1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_ROYSTON_A2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_ROYSTON_MU = [-1.5861, -0.31082, -0.083751, 0.0038915]
_ROYSTON_SD = [-0.4803, -0.082676, 0.0030302]
_ROYSTON_G = [-2.273, 0.459]
_ROYSTON_MU_SMALL = [0.544, -0.39978, 0.025054, -0.0006714]
_ROYSTON_SD_SMALL = [1.3822, -0.77857, 0.062767, -0.0020322]


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p for 3 to 5,000 values (Royston's approximation)."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("the test takes 3 to 5,000 values")
    norm = NormalDist()
    m = np.array([norm.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1 / math.sqrt(n)
    poly = np.polynomial.polynomial.polyval
    a = m / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = float(poly(u, _ROYSTON_A1)) + a[-1]
        if n > 5:
            second = float(poly(u, _ROYSTON_A2)) + a[-2]
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    if n <= 11:
        g = float(poly(n, _ROYSTON_G))
        z = -math.log(g - math.log(1 - w)) if g > math.log(1 - w) else float("inf")
        mu, sd = float(poly(n, _ROYSTON_MU_SMALL)), math.exp(float(poly(n, _ROYSTON_SD_SMALL)))
    else:
        z = math.log(1 - w)
        mu, sd = float(poly(math.log(n), _ROYSTON_MU)), math.exp(float(poly(math.log(n), _ROYSTON_SD)))
    return w, 1 - norm.cdf((z - mu) / sd)


def normality(df: DataFrame, col: str, keys: list[str], sample: int = 5000, seed: int = 42) -> DataFrame:
    """W test on a reproducible sample of at most 5,000 rows, beside the whole-table moments test."""
    if sample > 5000:
        raise ValueError("the W test is defined for at most 5,000 values")
    rows = df.where(F.col(col).isNotNull())
    picked = [r[col] for r in stable_sample(rows.select(*keys, col), keys, sample, seed).collect()]
    w, p = shapiro_wilk(picked)
    whole = jarque_bera(rows, col).select("n", "skew", "kurtosis", "jarque_bera", F.col("p").alias("jb_p"))
    return whole.select(
        F.lit(len(picked)).alias("sample_n"), F.lit(w).alias("W"), F.lit(p).alias("shapiro_p"), "*"
    )


def _neighbour_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per sorted partition: sums of squared steps and squares, and both end values."""
    start = first = last = None
    steps = squares = 0.0
    for pdf in batches:
        e = pdf["_e"].to_numpy()
        if not len(e):
            continue
        if first is None:
            start, first = pdf["_o"].iloc[0], float(e[0])
        else:
            steps += (e[0] - last) ** 2
        steps += float((np.diff(e) ** 2).sum())
        squares += float((e**2).sum())
        last = float(e[-1])
    if first is not None:
        yield pd.DataFrame([(start, first, last, steps, squares)], columns=["start", "first", "last", "steps", "squares"])


def durbin_watson(df: DataFrame, residual: str, order: str) -> DataFrame:
    """Sum of squared steps between neighbours in `order` over the sum of squares.

    The order column must be unique. Rows are range-partitioned and sorted, each partition is
    read once as a stream of batches, and the ends of adjoining partitions (one row each) are
    compared afterwards.
    """
    rows = df.select(F.col(order).alias("_o"), F.col(residual).cast("double").alias("_e")).dropna()
    kind = dict(rows.dtypes)["_o"]
    parts = rows.repartitionByRange("_o").sortWithinPartitions("_o").mapInPandas(
        _neighbour_steps, f"start {kind}, first double, last double, steps double, squares double"
    )
    seam = F.col("first") - F.lag("last").over(W.orderBy("start"))
    parts = parts.withColumn("seam", F.coalesce(seam * seam, F.lit(0.0)))
    return parts.agg(((F.sum("steps") + F.sum("seam")) / F.sum("squares")).alias("durbin_watson"))


class LinearFit:
    """Ordinary least squares from one pass of moments, with the usual inference."""

    def __init__(self, df: DataFrame, y: str, features: list[str]):
        self.df, self.y, self.features = df, y, features
        n, mean, cov = moments(df, [*features, y])
        k = len(features)
        sxx, sxy = cov[:k, :k], cov[:k, k]
        self.slopes = np.linalg.solve(sxx, sxy)
        self.intercept = float(mean[k] - self.slopes @ mean[:k])
        self.n, self.k = n, k
        self.means = mean[:k]
        self.sst = float(n * cov[k, k])
        self.sse = float(n * (cov[k, k] - self.slopes @ sxy))
        self.df_resid = n - k - 1
        sigma2 = self.sse / self.df_resid
        inv = np.linalg.inv(n * sxx)
        self.slope_se = np.sqrt(sigma2 * np.diag(inv))
        self.intercept_se = math.sqrt(sigma2 * (1 / n + float(self.means @ inv @ self.means)))

    def coefficients(self) -> DataFrame:
        rows = []
        for name, b, se in [
            ("const", self.intercept, self.intercept_se),
            *zip(self.features, self.slopes.tolist(), self.slope_se.tolist()),
        ]:
            t = b / se
            rows.append((name, float(b), float(se), float(t), t_two_sided(t, self.df_resid)))
        return self.df.sparkSession.createDataFrame(
            rows, "term string, coef double, std_err double, t double, p double"
        )

    def predicted(self) -> Column:
        out = F.lit(self.intercept)
        for f, b in zip(self.features, self.slopes.tolist()):
            out = out + F.lit(b) * F.col(f)
        return out

    def with_residuals(self, name: str = "residual") -> DataFrame:
        rows = self.df.dropna(subset=[*self.features, self.y])
        return rows.withColumn(name, F.col(self.y) - self.predicted())

    def summary(self, order: str | None = None) -> DataFrame:
        """One row: R2, adjusted R2, F and p, AIC, BIC, residual moments, Durbin-Watson by `order`."""
        r2 = 1 - self.sse / self.sst
        f = ((self.sst - self.sse) / self.k) / (self.sse / self.df_resid)
        llf = -self.n / 2 * (math.log(2 * math.pi) + math.log(self.sse / self.n) + 1)
        resid = self.with_residuals("_resid")
        values = {
            "n": F.lit(self.n).cast("long"),
            "r2": F.lit(r2),
            "adj_r2": F.lit(1 - (1 - r2) * (self.n - 1) / self.df_resid),
            "f": F.lit(f),
            "f_p": F.lit(f_tail(f, self.k, self.df_resid)),
            "aic": F.lit(-2 * llf + 2 * (self.k + 1)),
            "bic": F.lit(-2 * llf + math.log(self.n) * (self.k + 1)),
        }
        out = jarque_bera(resid, "_resid").select(
            *[v.alias(k) for k, v in values.items()], "skew", "kurtosis", "jarque_bera", F.col("p").alias("jb_p")
        )
        if order is not None:
            dw = durbin_watson(resid, "_resid", order)
            out = out.withColumn("durbin_watson", dw.scalar())
        return out

    def effects(self) -> DataFrame:
        """Base price exp(const) and percentage effect exp(b)-1 per unit of a feature."""
        rows = [("const", math.exp(self.intercept))]
        rows += [(f, math.exp(b) - 1) for f, b in zip(self.features, self.slopes.tolist())]
        return self.df.sparkSession.createDataFrame(rows, "term string, effect double")

