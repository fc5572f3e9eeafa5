import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions.geo import haversine_m, standard_geometry, wkt_centroid
from lotwise.functions.scores import RADII, count_name, distance_name, with_scores
from lotwise.operators import spatial
from lotwise.operators.spatial import PlaceIndex, poi_features

R = 6_371_000.0


def brute(lat, lon, plat, plon):
    a = np.sin(np.radians(plat[None] - lat[:, None]) / 2) ** 2 + np.cos(np.radians(lat[:, None])) * np.cos(
        np.radians(plat[None])
    ) * np.sin(np.radians(plon[None] - lon[:, None]) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.minimum(1, a)))


def check(spark, listings, poi, radii, **kw):
    ldf = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(listings)], "id int, lat double, lon double")
    pdf = spark.createDataFrame([(c, float(a), float(b)) for c, a, b in poi], "category string, lat double, lon double")
    got = poi_features(ldf, pdf, radii, **kw).toPandas().sort_values("id")
    assert len(got) == len(listings)
    lat, lon = np.array(listings).T
    for c, r in radii.items():
        mine = np.array([(a, b) for k, a, b in poi if k == c])
        d = brute(lat, lon, mine[:, 0], mine[:, 1])
        assert np.allclose(got[distance_name(c)], d.min(axis=1), atol=1e-6)
        assert list(got[count_name(c, r)]) == list((d <= r).sum(axis=1))


@pytest.mark.parametrize("leaf,limit", [(256, 32_000_000), (4, 32_000_000), (4, 0)])
def test_cells_equal_brute_force(spark, leaf, limit):
    """One leaf, deep cells, and deep cells joined by shuffle give the same answer."""
    rng = np.random.default_rng(1)
    listings = np.column_stack([-25 - rng.random(120) / 5, -50 - rng.random(120) / 5])
    listings = np.vstack([listings, listings[:5]])
    poi = [(c, -25 - a / 5, -50 - b / 5) for c in ("x", "y") for a, b in rng.random((150, 2))]
    check(spark, listings, poi, {"x": 500, "y": 2000}, leaf_points=leaf, broadcast_bytes=limit)


def test_dense_spot_and_copies(spark):
    """A third of all places in one block, many copies of one place, listings inside and far off."""
    rng = np.random.default_rng(2)
    spot = [("x", -25.05 + a / 2000, -50.05 + b / 2000) for a, b in rng.random((300, 2))]
    poi = spot + [("x", -25.05, -50.05)] * 200 + [("x", -25 - a / 5, -50 - b / 5) for a, b in rng.random((200, 2))]
    listings = np.vstack([[[-25.05, -50.05]] * 20, np.column_stack([-25 - rng.random(60) / 5, -50 - rng.random(60) / 5])])
    check(spark, listings, poi, {"x": 300}, leaf_points=8)


@pytest.mark.parametrize("limit", [0, 32_000_000])
def test_full_finest_cell_and_crowded_listings(spark, limit):
    """Many places within some millimetres, in arrays of a few, and most listings at one cell."""
    rng = np.random.default_rng(5)
    poi = [("x", -25.05 + a / 1e9, -50.05 + b / 1e9) for a, b in rng.random((200, 2))]
    poi += [("x", -25 - a / 5, -50 - b / 5) for a, b in rng.random((100, 2))] + [("y", -25.1, -50.1)]
    near = np.column_stack([-25.05 - rng.random(200) / 1e4, -50.05 - rng.random(200) / 1e4])
    listings = np.vstack([near, np.column_stack([-25 - rng.random(40) / 5, -50 - rng.random(40) / 5])])
    check(spark, listings, poi, {"x": 300, "y": 1000}, leaf_points=8, broadcast_bytes=limit)


def test_full_leaf_is_several_rows(spark):
    rng = np.random.default_rng(6)
    spot = [("x", -25.0 + float(a) / 1e9, -50.0 + float(b) / 1e9) for a, b in rng.random((400, 2))] + [("x", 10.0, 10.0)]
    index = PlaceIndex(spark.createDataFrame(spot, "category string, lat double, lon double"), leaf_points=16)
    sizes = [r["n"] for r in index.leaf_pts.select(F.size("pts").alias("n")).collect()]
    assert sum(sizes) == 401 and max(sizes) < 48 and len(sizes) > 16 and index.cells.count() <= 40


def test_one_half_of_the_features(spark):
    listings = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double")
    poi = spark.createDataFrame([("a", 0.001, 0.0)], "category string, lat double, lon double")
    assert poi_features(listings, poi, {"a": 500}, wanted=("count",)).columns == ["lat", "lon", "id", "qtd_a_500m"]
    assert "qtd_a_500m" not in poi_features(listings, poi, {"a": 500}, wanted=("distance",)).columns


def test_date_line_and_poles(spark):
    poi = [("x", 0.0, 179.999), ("x", 89.9999, 10.0), ("x", -89.9999, 0.0), ("x", 10.0, -179.5)]
    listings = [(0.0, -179.999), (89.9999, -170.0), (-89.99, 180.0), (10.0, 179.9), (45.0, 45.0)]
    check(spark, listings, poi, {"x": 50_000}, leaf_points=1)


def test_edges(spark):
    listings = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, lat double, lon double")
    one_degree = 2 * R * math.asin(math.sqrt(math.sin(math.radians(1.0) / 2) ** 2))
    poi = spark.createDataFrame(
        [("a", 1.0, 0.0), ("a", None, 0.0), ("b", 0.0, 0.0)], "category string, lat double, lon double"
    )
    rows = poi_features(listings, poi, {"a": one_degree, "b": 1, "c": 10}).orderBy("id").collect()
    here, nowhere = rows
    assert here["dist_a_mais_proximo"] == pytest.approx(111_194.93, abs=0.01)
    assert here[count_name("a", one_degree)] == 1
    assert (here["dist_b_mais_proximo"], here["qtd_b_1m"]) == (0.0, 1)
    assert (here["dist_c_mais_proximo"], here["qtd_c_10m"]) == (None, 0)
    assert (nowhere["dist_a_mais_proximo"], nowhere["qtd_b_1m"]) == (None, 0)
    none = poi_features(listings, poi.limit(0), {"a": 5}).collect()
    assert [(r["dist_a_mais_proximo"], r["qtd_a_5m"]) for r in none] == [(None, 0)] * 2


def test_nearest_within_radius_means_count(spark):
    rng = np.random.default_rng(3)
    listings = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((200, 2)) / 20)], "id int, lat double, lon double")
    poi = spark.createDataFrame([("x", float(a), float(b)) for a, b in rng.random((80, 2)) / 20], "category string, lat double, lon double")
    out = poi_features(listings, poi, {"x": 400}, leaf_points=8)
    assert out.where((F.col("dist_x_mais_proximo") <= 400) != (F.col("qtd_x_400m") >= 1)).count() == 0


WKT = {
    "POINT (-50.1 -25.1)": (-25.1, -50.1),
    "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))": (1.0, 1.0),
    "POLYGON ((-50 -25, -48 -25, -48 -23, -50 -23, -50 -25))": (-24.0, -49.0),
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 2, 0 2, 0 0))": (7 / 3, 7 / 3),
    "MULTIPOLYGON (((0 0,1 0,1 1,0 1,0 0)),((2 0,3 0,3 1,2 1,2 0)))": (0.5, 1.5),
    "LINESTRING (0 0, 2 0)": (0.0, 1.0),
    "MULTIPOINT ((0 0),(2 2))": (1.0, 1.0),
    "POLYGON ((0 0, 2 0, 0 0))": (0.0, 1.0),
    "garbage": (None, None),
    "POINT EMPTY": (None, None),
    "POINT (a b)": (None, None),
    None: (None, None),
}


def test_centroids(spark):
    rows = spark.createDataFrame([(k,) for k in WKT], "g string").select("g", wkt_centroid(F.col("g")).alias("c"))
    for r in rows.collect():
        lat, lon = WKT[r["g"]]
        assert r["c"]["lat"] == (None if lat is None else pytest.approx(lat, abs=1e-12))
        assert r["c"]["lon"] == (None if lon is None else pytest.approx(lon, abs=1e-12))


def test_standard_geometry(spark):
    row = spark.range(1).select(
        standard_geometry(F.lit("POINT (1 2)")), standard_geometry(F.lit("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"))
    ).first()
    assert tuple(row) == ("POINT (1 2)", "POINT (1.0 1.0)")


def test_scores_without_poi_are_null(spark):
    cols = {distance_name(c): F.lit(None).cast("double") for c in RADII} | {count_name(c, r): F.lit(0) for c, r in RADII.items()}
    row = with_scores(spark.range(1).withColumns(cols)).first()
    assert row["score_parque"] is None


def test_same_point(spark):
    assert spark.range(1).select(haversine_m(F.lit(1.5), F.lit(2.5), F.lit(1.5), F.lit(2.5))).first()[0] == 0.0


def test_tasks_hold_a_bounded_number_of_points_and_places(spark, monkeypatch):
    """More listings are walked by more tasks, and places are read from files, not from a fixed number of kept parts."""
    rows = spark.range(2000).select((F.col("id") / -100.0).alias("lat"), F.lit(-50.0).alias("lon"))
    monkeypatch.setattr(spatial, "POINTS_A_TASK", 100)
    points = spatial.distinct_points(rows)
    assert points.select(F.spark_partition_id().alias("p")).distinct().count() == 20 and points.count() == 2000
    seen, plain = [], spatial.cell_tree
    monkeypatch.setattr(spatial, "cell_tree", lambda pts, n: seen.append(pts) or plain(pts, n))
    spatial.PlaceIndex(rows.withColumn("category", F.lit("a")))
    assert seen[0].inputFiles() and not seen[0].is_cached
