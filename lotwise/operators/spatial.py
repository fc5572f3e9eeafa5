"""Nearest distance and within-radius counts of points of interest (POI).

POIs are laid out in nested cells over the unit sphere, each category refined only where it
is dense: a cell with at most LEAF_POINTS places carries them as an array, a fuller one is cut
in four along each axis; a full cell of the finest level carries its places in several arrays.
Listings walk down those cells by equi-joins on the cell key and drop every cell that can no
longer matter, so the work per listing stays small even when one spot holds most of the POIs,
and no list of listing-POI pairs is ever built. Equal coordinates are collapsed on both sides
first. The cells are broadcast where their bytes allow it; else they are shuffled, and before
each step the cells at which many listings stand are counted and copied, they alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lotwise.functions.geo import EARTH_RADIUS_M, haversine_m, unit_xyz
from lotwise.functions.scores import RADII, count_name, distance_name
from lotwise.operators.joins import lookup_join
from lotwise.session import cut_lineage

LEAF_POINTS = 256
# Cells of level 13 are about 20 cm wide; each level is four times finer per axis.
FINEST_LEVEL = 13
# Estimated bytes of the cell table up to which it is broadcast, and of its rows.
BROADCAST_BYTES = 64_000_000
CELL_BYTES, PLACE_BYTES = 200, 64
# In the shuffled form, a cell at which more listings stand than this share of them all gets a copy for every such
# share; at most 1 / HOT_SHARE cells can be that crowded.
HOT_SHARE = 1 / 256
POINTS_A_TASK = 10_000  # distinct coordinates of listings that one task walks with at most
AXES = ("x", "y", "z")


def _cell(axis: str, level: Column) -> Column:
    """Cell index at a level, from the index at the finest level."""
    return F.call_function("shiftright", F.col(f"_i{axis}"), (F.lit(FINEST_LEVEL) - level) * 2)


def _cell_key(level: Column) -> Column:
    return F.concat_ws(":", level, *[_cell(a, level) for a in AXES])


def places(poi: DataFrame) -> DataFrame:
    """Distinct (category, lat, lon) with the number of POIs there; no coordinates, no place."""
    p = (
        poi.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .groupBy("category", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    xyz = dict(zip(AXES, unit_xyz(F.col("lat"), F.col("lon"))))
    top = 4**FINEST_LEVEL - 1
    index = {
        f"_i{a}": F.least(F.lit(top), F.floor((F.col(a) + 1) / 2 * 4**FINEST_LEVEL)).cast("long") for a in AXES
    }
    return p.withColumns(xyz).withColumns(index)


def cell_tree(pts: DataFrame, leaf_points: int = LEAF_POINTS) -> tuple[DataFrame, DataFrame]:
    """Cells as rows (category, node, parent, depth, leaf, cnt, n, bounds), and the places of the leaves as rows
    (category, node, pts) of some `leaf_points` places.

    Level by level, only places in full cells go on to the next; cells with a single child are skipped, so the number of
    levels follows the density.
    """
    bounds = [f(a).alias(f"{a}{s}") for a in AXES for f, s in ((F.min, 0), (F.max, 1))]
    names = [f"_c{a}" for a in AXES]  # whole numbers name the cells of one level
    listed = F.collect_list(F.struct("lat", "lon", "x", "y", "z", "w")).alias("pts")
    found, leaf_pts, full = [], [], None
    for level in range(FINEST_LEVEL + 1):
        # a place in a full cell was in full cells all the way down
        named = pts if full is None else pts.withColumns(numbers).join(full, ["category", *names], "left_semi")
        numbers = {n: _cell(a, F.lit(level)).cast("int") for n, a in zip(names, AXES)}
        named = named.withColumns(numbers)
        cells = named.groupBy("category", *names).agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("cnt"), *bounds, *[F.first(f"_i{a}").alias(f"_i{a}") for a in AXES]
        )
        cells = cut_lineage(cells.withColumns({
            "level": F.lit(level), "node": _cell_key(F.lit(level)), "up": _cell_key(F.lit(level - 1)) if level else F.lit(None).cast("string"),
            "leaf": (F.col("n") <= leaf_points) | F.lit(level == FINEST_LEVEL),
        }), "cells")
        found.append(cells)
        # a leaf's places are dealt into as many arrays as its number asks for
        array = F.pmod(F.xxhash64("lat", "lon"), F.greatest(F.lit(1), F.ceil(F.col("n") / leaf_points)))
        mine = lookup_join(named, cells.where("leaf").select("category", *names, "node", "n"), ["category", *names], "inner")
        leaf_pts.append(mine.groupBy("category", "node", array.alias("_array")).agg(listed))
        full = cells.where("NOT leaf").select("category", *names)
        if full.isEmpty():
            break
    cells = reduce(DataFrame.unionByName, found)
    leaves, inner, children = cells.where("leaf"), cells.where("NOT leaf"), cells.where("level > 0")
    branching = (
        children.groupBy("category", F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    )
    kept = inner.join(branching.select("category", "node"), ["category", "node"], "left_semi")
    nodes = leaves.unionByName(kept)
    above = (
        nodes.where("level > 0")
        .withColumn("_above", F.explode(F.sequence(F.lit(0), F.col("level") - 1)))
        .select("category", "node", "_above", _cell_key(F.col("_above")).alias("parent"))
    )
    ancestors = (
        lookup_join(above, kept.select("category", F.col("node").alias("parent")), ["category", "parent"], "inner")
        .groupBy("category", "node")
        .agg(F.max_by("parent", "_above").alias("parent"), F.count(F.lit(1)).cast("int").alias("depth"))
    )
    tree = nodes.join(ancestors, ["category", "node"], "left")
    tree = tree.withColumns({"parent": F.coalesce("parent", F.lit("")), "depth": F.coalesce("depth", F.lit(0))})
    cell_columns = ["category", "node", "parent", "depth", "leaf", "cnt", "n", *[f"{a}{s}" for a in AXES for s in (0, 1)]]
    return tree.select(*cell_columns), reduce(DataFrame.unionByName, leaf_pts).select("category", "node", "pts")


class PlaceIndex:
    """The written cell and leaf tables with their estimated bytes."""

    def __init__(self, poi: DataFrame, leaf_points: int = LEAF_POINTS, broadcast_bytes: int = BROADCAST_BYTES):
        # written, not kept: a task reads a share of the files that has a fixed size, however many places there are
        cells, leaf_pts = cell_tree(cut_lineage(places(poi), "places"), leaf_points)
        self.cells, self.leaf_pts = cut_lineage(cells, "tree"), cut_lineage(leaf_pts, "leaves")
        size = self.cells.agg(
            F.max("depth").alias("d"), F.count(F.lit(1)).alias("cells"), F.sum(F.when(F.col("leaf"), F.col("n"))).alias("places")
        ).first()
        self.depth = size["d"] + 1 if size["cells"] else 0
        self.bytes = size["cells"] * CELL_BYTES + (size["places"] or 0) * PLACE_BYTES
        self.small = self.bytes <= broadcast_bytes

    def children(self) -> DataFrame:
        return self.cells.select(
            F.col("category").alias("_cat"),
            F.col("node").alias("_key"),
            F.col("parent").alias("_parent"),
            F.col("cnt").alias("_cnt"),
            F.col("leaf").alias("_is_leaf"),
            *[f"{a}{s}" for a in AXES for s in (0, 1)],
        )

    def leaves(self) -> DataFrame:
        return self.leaf_pts.select(F.col("category").alias("_cat"), F.col("node").alias("_leaf"), "pts")

    def meet(self, state: DataFrame, at: str, cells: DataFrame, key: str) -> DataFrame:
        """Left join of the rows of `state` to the cells whose `key` is their column `at` (null meets nothing)."""
        same = (F.col("category") == F.col("_cat")) & (_spread_key(at) == F.col(key))
        if self.small:
            return state.join(F.broadcast(cells), same, "left").drop("_cat")
        state = cut_lineage(state, "walk")
        standing = state.where(F.col(at).isNotNull())
        crowd = max(1, math.ceil(standing.count() * HOT_SHARE))
        hot = (
            standing.groupBy(F.col("category").alias("_hot_cat"), F.col(at).alias("_hot_key"))
            .agg(F.ceil(F.count(F.lit(1)) / F.lit(crowd)).cast("int").alias("_copies"))
            .where("_copies > 1")
        )
        hot = F.broadcast(cut_lineage(hot, "hot"))  # fewer than 1 / HOT_SHARE rows
        ours = state.join(hot, (F.col("category") == F.col("_hot_cat")) & (F.col(at) == F.col("_hot_key")), "left")
        ours = ours.withColumn("_copy", F.pmod(F.xxhash64("lat", "lon"), F.coalesce("_copies", F.lit(1))).cast("int"))
        theirs = cells.join(hot, (F.col("_cat") == F.col("_hot_cat")) & (F.col(key) == F.col("_hot_key")), "left")
        theirs = theirs.withColumn("_their_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
        extra = ("_hot_cat", "_hot_key", "_copies")
        met = ours.drop(*extra).join(theirs.drop(*extra), same & (F.col("_copy") == F.col("_their_copy")), "left")
        return met.drop("_cat", "_copy", "_their_copy")


def distinct_points(listings: DataFrame) -> DataFrame:
    """Distinct coordinates, spread by coordinate over all shuffle partitions, or more where one had over POINTS_A_TASK.

    The walk makes much work from few bytes, so the partition count follows the number of points rather than
    being left to merging by size.
    """
    points = listings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon").distinct()
    points = cut_lineage(points, "points")
    n = max(int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(points.count() / POINTS_A_TASK))
    return points.withColumns(dict(zip(AXES, unit_xyz(F.col("lat"), F.col("lon"))))).repartition(n, "lat", "lon")


def _chord(radius: float) -> float:
    return 2 * math.sin(min(radius / (2 * EARTH_RADIUS_M), math.pi / 2))


def _bounds() -> tuple[Column, Column]:
    """Squared chord to the nearest and to the farthest corner of a cell."""
    low = high = None
    for a in AXES:
        p, lo, hi = F.col(a), F.col(f"{a}0"), F.col(f"{a}1")
        near = F.greatest(lo - p, p - hi, F.lit(0.0))
        far = F.greatest(F.abs(p - lo), F.abs(p - hi))
        low = near * near if low is None else low + near * near
        high = far * far if high is None else high + far * far
    return low, high


def _squared_chord() -> Column:
    out = None
    for a in AXES:
        d = F.col(f"_p.{a}") - F.col(a)
        out = d * d if out is None else out + d * d
    return out


def _spread_key(name: str) -> Column:
    """The cell key; rows without one get spread-out keys that match nothing."""
    return F.coalesce(F.col(name), F.concat(F.lit("-"), F.pmod(F.xxhash64("lat", "lon"), F.lit(4096)).cast("string")))


def _step(state: DataFrame, index: PlaceIndex) -> DataFrame:
    """Rows with an open cell meet its children, the others (node is null) pass through."""
    return index.meet(state, "node", index.children(), "_parent")


def _leaf_places(state: DataFrame, index: PlaceIndex) -> DataFrame:
    """One row per place `_p` of every leaf still in play."""
    met = index.meet(state, "leaf", index.leaves(), "_leaf").drop("_leaf")
    return met.select("*", F.explode_outer("pts").alias("_p")).drop("pts")


def radii_of(radii: dict[str, float | Sequence[float]]) -> list[tuple[str, float]]:
    """(category, radius) of a mapping whose values are one radius or several."""
    return [(c, r) for c, rs in radii.items() for r in (rs if isinstance(rs, (list, tuple)) else (rs,))]


def radius_counts(points: DataFrame, index: PlaceIndex, radii: dict[str, float | Sequence[float]]) -> DataFrame:
    """(lat, lon, category, radius, n): POIs within each of the category's radii, the edge included."""
    requests = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("category"),
                    F.lit(float(r)).alias("radius"),
                    # Rounding slack: between the two limits the metres decide.
                    F.lit(max(_chord(r) * (1 - 1e-9) - 1e-14, 0.0) ** 2).alias("sure_in"),
                    F.lit((_chord(r) * (1 + 1e-9) + 1e-14) ** 2).alias("sure_out"),
                )
                for c, r in radii_of(radii)
            ]
        )
    )
    keep = ["lat", "lon", *AXES, "category", "radius", "sure_in", "sure_out"]
    state = points.select("lat", "lon", *AXES, requests.alias("_q")).select("lat", "lon", *AXES, "_q.*")
    state = state.withColumns(
        {"node": F.lit(""), "leaf": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}
    )
    low, high = _bounds()
    met = F.col("node").isNotNull()
    covered = met & (high < F.col("sure_in"))
    for _ in range(index.depth):
        state = (
            _step(state, index)
            .where(~met | (low <= F.col("sure_out")))
            .select(
                *keep,
                F.when(met & ~covered & ~F.col("_is_leaf"), F.col("_key")).alias("node"),
                F.when(~met, F.col("leaf")).when(~covered & F.col("_is_leaf"), F.col("_key")).alias("leaf"),
                F.when(covered, F.col("_cnt")).otherwise(F.col("n")).alias("n"),
            )
        )
    c2 = _squared_chord()
    edge = haversine_m(F.col("lat"), F.col("lon"), F.col("_p.lat"), F.col("_p.lon")) <= F.col("radius")
    counted = (
        F.when(F.col("leaf").isNull(), F.col("n"))
        .when(c2 < F.col("sure_in"), F.col("_p.w"))
        .when((c2 <= F.col("sure_out")) & edge, F.col("_p.w"))
    )
    return (
        _leaf_places(state, index)
        .select("lat", "lon", "category", "radius", counted.alias("n"))
        .where("n > 0")
        .groupBy("lat", "lon", "category", "radius")
        .agg(F.sum("n").alias("n"))
    )


def nearest_distance(points: DataFrame, index: PlaceIndex, categories: list[str]) -> DataFrame:
    """(lat, lon, category, metres) to the nearest POI of every category that has any."""
    keep = ["lat", "lon", *AXES, "category"]
    cats = F.explode(F.array(*[F.lit(c) for c in categories]))
    state = points.select("lat", "lon", *AXES, cats.alias("category")).withColumns(
        {"node": F.lit(""), "leaf": F.lit(None).cast("string"), "lo": F.lit(0.0), "hi": F.lit(16.0)}
    )
    low, high = _bounds()
    met = F.col("node").isNotNull()
    same = W.partitionBy("lat", "lon", "category")
    for turn in range(index.depth):
        state = (
            _step(state, index)
            .where(~met | F.col("_key").isNotNull())
            .select(
                *keep,
                F.when(met & ~F.col("_is_leaf"), F.col("_key")).alias("node"),
                F.when(met & F.col("_is_leaf"), F.col("_key")).otherwise(F.col("leaf")).alias("leaf"),
                F.when(met, low).otherwise(F.col("lo")).alias("lo"),
                F.when(met, high).otherwise(F.col("hi")).alias("hi"),
            )
        )
        if turn:  # a category starts from one cell, so there is nothing to drop in the first turn
            state = (
                state.withColumn("_best", F.sqrt(F.min("hi").over(same)))
                .where(F.sqrt("lo") <= F.col("_best") * (1 + 1e-9) + 1e-14)
                .drop("_best")
            )
    nearest = (
        _leaf_places(state, index)
        .select("lat", "lon", "category", _squared_chord().alias("_c2"))
        .groupBy("lat", "lon", "category")
        .agg(F.min("_c2").alias("_c2"))
    )
    metres = F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt("_c2") / 2))
    return nearest.select("lat", "lon", "category", metres.alias("metres"))


def poi_features(
    listings: DataFrame,
    poi: DataFrame,
    radii: dict[str, float | Sequence[float]] = RADII,
    leaf_points: int = LEAF_POINTS,
    broadcast_bytes: int = BROADCAST_BYTES,
    wanted: Sequence[str] = ("distance", "count"),
) -> DataFrame:
    """Listings plus nearest distance (null without POIs) per category and a count for each of its radii.

    `listings` has lat/lon, `poi` has category/lat/lon; `wanted` may name one half of the features. Listings at equal
    coordinates share one computation; hot coordinates are kept out of the shuffle of the join back.
    """
    index = PlaceIndex(poi.where(F.col("category").isin(list(radii))), leaf_points, broadcast_bytes)
    points = distinct_points(listings)
    mine, found, aggs = F.col("category"), [], {}
    if "distance" in wanted:
        if index.depth:
            found.append(nearest_distance(points, index, list(radii)))
        aggs |= {distance_name(c): F.min(F.when(mine == c, F.col("metres"))) for c in radii}
    if "count" in wanted:
        if index.depth:
            found.append(radius_counts(points, index, radii))
        aggs |= {
            count_name(c, r): F.max(F.when((mine == c) & (F.col("radius") == F.lit(float(r))), F.col("n")))
            for c, r in radii_of(radii)
        }
    counts = [n for n in (count_name(c, r) for c, r in radii_of(radii)) if n in aggs]
    if found:
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        wide = cut_lineage(both.groupBy("lat", "lon").agg(*[a.alias(n) for n, a in aggs.items()]), "poi-features")
        out = lookup_join(listings, wide, ["lat", "lon"])
    else:
        out = listings.withColumns({n: F.lit(None).cast("long" if n in counts else "double") for n in aggs})
    return out.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in counts})
