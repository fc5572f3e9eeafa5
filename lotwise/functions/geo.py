"""Great-circle distance and WKT centroids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lotwise.functions.binding import let

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def unit_xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; chords there grow with the great-circle distance."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def geometry_kind(wkt: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1)), F.lit(""))


_SHAPE = (
    r"(?is)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON)\s*\(.*\)\s*$"
)


def _vertices(body: Column) -> Column:
    """'x y, x y' to an array of (x, y)."""
    return F.transform(
        F.split(F.trim(body), r"\s*,\s*"),
        lambda p: F.struct(
            F.split(p, r"\s+").getItem(0).try_cast("double").alias("x"),
            F.try_element_at(F.split(p, r"\s+"), F.lit(2)).try_cast("double").alias("y"),
        ),
    )


def _segments(points: Column) -> Column:
    n = F.size(points)
    return F.arrays_zip(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"),
        F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"),
    )


def _sum3(items: Column, weight, px, py) -> Column:
    """Sum of weight, weight*px and weight*py over an array."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        items,
        zero,
        lambda acc, s: F.struct(
            (acc["w"] + weight(s)).alias("w"),
            (acc["x"] + weight(s) * px(s)).alias("x"),
            (acc["y"] + weight(s) * py(s)).alias("y"),
        ),
    )


_ZERO = ("w", "x", "y")


def _total(parts: Column) -> Column:
    """Sum of an array of (w, x, y)."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in _ZERO])
    return F.aggregate(parts, zero, lambda acc, s: F.struct(*[(acc[n] + s[n]).alias(n) for n in _ZERO]))


def _ring_area(ring: Column, opener: Column) -> Column:
    """Area and area-weighted middle of a ring; positive when it is an outer ring."""

    def cross(s: Column) -> Column:
        return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]

    def signed(s: Column) -> Column:
        side = F.signum(s["w"]) * F.when(opener == "(", F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.struct(*[(s[n] * side).alias(n) for n in _ZERO])

    third = {n: (lambda e, n=n: (e["a"][n] + e["b"][n]) / 3) for n in ("x", "y")}
    return let(_sum3(_segments(ring), cross, third["x"], third["y"]), signed)


def _ring_length(ring: Column) -> Column:
    def length(s: Column) -> Column:
        return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])

    half = {n: (lambda e, n=n: (e["a"][n] + e["b"][n]) / 2) for n in ("x", "y")}
    return _sum3(_segments(ring), length, half["x"], half["y"])


def _middle(kind: Column, openers: Column, rings: Column) -> Column:
    """Centroid of parsed rings: by area, else by line length, else by points."""

    def around(origin: Column) -> Column:
        local = F.transform(
            rings,
            lambda ring: F.transform(
                ring,
                lambda v: F.struct((v["x"] - origin["x"]).alias("x"), (v["y"] - origin["y"]).alias("y")),
            ),
        )

        def place(s: Column) -> Column:
            return F.struct(
                (origin["y"] + F.try_divide(s["y"], s["w"])).alias("lat"),
                (origin["x"] + F.try_divide(s["x"], s["w"])).alias("lon"),
            )

        def choose(shape: Column) -> Column:
            points = _sum3(F.flatten(shape), lambda v: F.lit(1.0), lambda v: v["x"], lambda v: v["y"])

            def by_line(s: Column) -> Column:
                return F.when(~kind.isin("POINT", "MULTIPOINT") & (s["w"] != 0), s).otherwise(points)

            def by_area(s: Column) -> Column:
                return F.when(kind.isin("POLYGON", "MULTIPOLYGON") & (s["w"] != 0), s).otherwise(
                    let(_total(F.transform(shape, _ring_length)), by_line)
                )

            return let(let(_total(F.zip_with(shape, openers, _ring_area)), by_area), place)

        return let(local, choose)

    return let(F.element_at(F.element_at(rings, 1), 1), around)


def wkt_centroid(wkt: Column) -> Column:
    """Struct (lat, lon) of the centroid; both null where the text is not a usable shape.

    Areas are summed with the first vertex as origin, holes count negative; shapes without
    area fall back to their lines and then to their points.
    """
    missing = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    # An outer ring opens directly after another bracket, a hole after a comma.
    openers = F.regexp_extract_all(wkt, F.lit(r"(\(?)\s*\([^()]+\)"), F.lit(1))

    def parsed(rings: Column) -> Column:
        bad = F.exists(F.flatten(rings), lambda v: (v["x"] + v["y"]).isNull())
        usable = (F.size(rings) > 0) & ~bad
        return F.when(usable, _middle(geometry_kind(wkt), openers, rings)).otherwise(missing)

    return F.when(wkt.rlike(_SHAPE), let(F.transform(bodies, _vertices), parsed)).otherwise(missing)


def with_centroid(df, geometry: str | None = None):
    """Add lat/lon unless both exist; prefers geometry_std over geometry."""
    if {"lat", "lon"} <= set(df.columns):
        return df
    source = geometry or ("geometry_std" if "geometry_std" in df.columns else "geometry")
    point = wkt_centroid(F.col(source))
    return (
        df.withColumn("_centroid", point)
        .withColumns({"lat": F.col("_centroid.lat"), "lon": F.col("_centroid.lon")})
        .drop("_centroid")
    )


def standard_geometry(wkt: Column) -> Column:
    """Points stay as they are, every other shape becomes its centroid point."""
    def as_point(c: Column) -> Column:
        text = F.concat(F.lit("POINT ("), c["lon"].cast("string"), F.lit(" "), c["lat"].cast("string"), F.lit(")"))
        return F.when(c["lat"].isNotNull(), text)

    return F.when(geometry_kind(wkt) == "POINT", wkt).otherwise(let(wkt_centroid(wkt), as_point))
