import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import filters, profile
from lotwise.operators.dedup import keep_first, union_all
from lotwise.operators.geocode import failed_addresses, lookup_status, resolve
from lotwise.operators.joins import lookup_join, pending_keys
from lotwise.operators.profile import correlation_pairs, group_stats, null_profile
from lotwise.operators.sampling import hash_split, stable_sample


def test_keep_first_follows_string_order_and_joins_null_keys(spark):
    rows = [("l", "pagina2", 1), ("l", "pagina10", 1), ("l", "pagina1", 1), (None, "pagina1", 2), (None, "pagina3", 1)]
    df = spark.createDataFrame(rows, "link string, file string, row int")
    got = {r["link"]: r["file"] for r in keep_first(df, ["link"], ["file", "row"]).collect()}
    assert got == {"l": "pagina1", None: "pagina1"}
    without = keep_first(df.where("file <> 'pagina1'"), ["link"], ["file", "row"])
    assert {r["link"]: r["file"] for r in without.collect()} == {"l": "pagina10", None: "pagina3"}
    once = keep_first(df, ["link"], ["file", "row"])
    assert keep_first(once, ["link"], ["file", "row"]).count() == once.count() == 2


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y",)], "s string")
    assert {tuple(r) for r in union_all([a, b]).collect()} == {(1, "x"), (None, "y")}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_and_null_keys_join_like_any_other(spark, how):
    left = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 900).alias("k"),
    )
    lookup = spark.range(-1, 600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(lookup, "k", how)
    apart = lookup_join(left, lookup, ["k"], how, written=False)
    assert sorted(map(str, apart.select("id", "k", "v").collect())) == sorted(map(str, plain.select("id", "k", "v").collect()))


CACHE = [("Rua A, Centro, C", 1.0, 2.0), ("Rua B, Centro, C", None, None), ("Rua E, Sul, C", None, None)]
ALT = [("Rua B, C", 3.0, 4.0), ("Rua D, C", 5.0, 6.0)]


def test_geocode_cascade(spark):
    rows = [(1, " Rua A ", "Centro"), (2, "Rua B", "Centro"), (3, "Rua E", "Sul"), (4, None, "Centro"), (5, "Rua D", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, rua string, bairro string")
    cache = spark.createDataFrame(CACHE, "endereco_geo string, lat double, lon double")
    alt = spark.createDataFrame(ALT, "endereco_alt string, lat_alt double, lon_alt double")
    out = resolve(df, cache, alt, suffix=("C",)).orderBy("id").collect()
    assert [(r["lat"], r["geocode_stage"], r["nivel_geocoding"]) for r in out] == [
        (1.0, "rua_bairro", "rua_bairro"), (3.0, "rua", "rua_bairro"), (None, "falhou", "falhou"),
        (None, "falhou", "falhou"), (5.0, "rua", "rua"), (None, "falhou", "falhou"),
    ]
    assert [r["endereco_geo"] for r in out] == ["Rua A, Centro, C", "Rua B, Centro, C", "Sul, C", "Centro, C", None, None]
    area = spark.createDataFrame([("Sul, C", 7.0, 8.0)], "endereco_bairro string, lat_bairro double, lon_bairro double")
    third = resolve(df, cache, alt, area, suffix=("C",)).where("id = 3").first()
    assert (third["lat"], third["geocode_stage"]) == (7.0, "bairro")
    assert failed_addresses(resolve(df, cache, alt, suffix=("C",))).count() == 3


def test_duplicate_cache_rows_do_not_multiply_listings(spark):
    df = spark.createDataFrame([(1, "Rua A", "Centro")], "id int, rua string, bairro string")
    cache = spark.createDataFrame([CACHE[0], ("Rua A, Centro, C", None, None)], "endereco_geo string, lat double, lon double")
    assert [r["lat"] for r in resolve(df, cache, suffix=("C",)).collect()] == [1.0]


def test_lookup_status_and_pending(spark):
    df = spark.createDataFrame([("Rua A, Centro, C",), ("Rua B, Centro, C",), ("x",), (None,), ("x",)], "k string")
    cache = spark.createDataFrame(CACHE, "endereco_geo string, lat double, lon double")
    got = {r["k"]: r["status"] for r in lookup_status(df, "k", cache).collect()}
    assert got == {"Rua A, Centro, C": "sucesso", "Rua B, Centro, C": "nao_encontrado", "x": "erro", None: "erro"}
    assert [r["k"] for r in pending_keys(df, "k", cache, "endereco_geo").collect()] == ["x"]


def test_request_rules(spark):
    base = {"quartos": 3, "banheiros": 1, "vagas_garagem": 0, "area_m2": 50.0, "bairro": "C", **{s: 0.0 for s in filters.SCORE_FIELDS}}
    cases = [
        ({}, []), ({"quartos": -1}, ["quartos:low"]), ({"quartos": 0}, []), ({"quartos": 20}, []), ({"quartos": 21}, ["quartos:high"]),
        ({"area_m2": 0.0}, ["area_m2:low"]), ({"area_m2": 0.01}, []), ({"area_m2": 10000.0}, []), ({"area_m2": 10000.01}, ["area_m2:high"]),
        ({"score_parque": -0.1}, ["score_parque:low"]), ({"bairro": None}, ["bairro:missing"]), ({"score_parque": None}, []),
        ({"vagas_garagem": None}, []),
    ]
    names = list(base)
    schema = ", ".join(f"{n} {'string' if n == 'bairro' else 'double' if n == 'area_m2' or n.startswith('score') else 'int'}" for n in names)
    df = spark.createDataFrame([tuple({**base, **c}[n] for n in names) for c, _ in cases], schema)
    assert [r["violations"] for r in filters.with_violations(df).collect()] == [v for _, v in cases]
    good, bad = filters.split_valid(df)
    assert (good.count(), bad.count()) == (sum(not v for _, v in cases), sum(bool(v) for _, v in cases))


def test_reach_and_last_row(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, None), (3, 5.0, 200_000.0), (4, 99_999.0, 1.0)], "i int, a double, b double")
    assert [r["i"] for r in filters.within_reach(df, ["a", "b"]).orderBy("i").collect()] == [1, 4]
    assert [r["i"] for r in filters.without_last(df, ["i"]).orderBy("i").collect()] == [1, 2, 3]


def test_group_stats_keeps_groups_with_enough_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0), (None, 1.0), (None, 2.0)], "g string, x double")
    assert [tuple(r) for r in group_stats(df, "g", "x", 2).select("g", "median", "mean", "n").collect()] == [("a", 2.0, 2.0, 2)]


def test_pairwise_correlation_skips_nulls_per_pair(spark):
    rng = np.random.default_rng(0)
    x = rng.random((50, 3))
    rows = [tuple(None if (i + j) % 7 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = df.toPandas().corr()
    for r in correlation_pairs(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-12)


def test_null_profile_counts(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (float("nan"), "y"), (float("inf"), "z")], "a double, s string")
    got = {r["column"]: (r["non_null"], r["nulls"], r["infinite"]) for r in null_profile(df).collect()}
    assert got == {"a": (2, 2, 1), "s": (3, 1, 0)}


def test_split_and_sample_do_not_depend_on_partitions(spark):
    df = spark.range(3000)
    train, test = hash_split(df, ["id"])
    again, _ = hash_split(df.repartition(13), ["id"])
    assert train.count() + test.count() == 3000 and abs(test.count() - 600) < 90
    assert train.exceptAll(again).count() == 0
    assert stable_sample(df, ["id"], 50).exceptAll(stable_sample(df.repartition(5), ["id"], 50)).count() == 0


@pytest.mark.parametrize("kind", ["normal", "few", "outliers", "repeated"])
def test_density_equals_plain_sums(spark, kind):
    """Moments of cells against the sum over all values, within the stated error."""
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(size=5000), "few": np.array([1.0, 4.0, 4.5]), "repeated": rng.integers(0, 9, 4000).astype(float),
        "outliers": np.concatenate([rng.normal(size=3000), [500.0, -40.0]]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    rows = profile.kernel_density(df, "v", 120).orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    at = np.linspace(values.min() - 3 * h, values.max() + 3 * h, 120)
    want = np.exp(-(((at[:, None] - values[None]) / h) ** 2) / 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert len(rows) == 120 and np.allclose([r["x"] for r in rows], at)
    assert np.abs(np.array([r["density"] for r in rows]) - want).max() < 1e-13 / h


def test_density_needs_two_values(spark):
    with pytest.raises(ValueError):
        profile.kernel_density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v")
