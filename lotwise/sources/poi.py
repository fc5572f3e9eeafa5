"""POI service responses and POI tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.functions.geo import with_centroid
from lotwise.functions.rules import school_class
from lotwise.schemas import POI_RESPONSE

# Tags that select each POI group; lists mean any of the values.
POI_TAGS = {
    "hospital": {"amenity": "hospital"},
    "mercado": {"shop": ["supermarket", "convenience"]},
    "farmacia": {"amenity": "pharmacy"},
    "parque": {"leisure": ["park", "garden"], "landuse": "recreation_ground"},
    "escola": {"amenity": ["school", "college", "university"]},
    "policia": {"amenity": ["police", "fire_station", "courthouse"]},
}


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of the JSON responses below a path."""
    raw = spark.read.schema(POI_RESPONSE).option("multiLine", True).json(path)
    return explode_elements(raw)


def explode_elements(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("elements").alias("e")).select("e.*")


def tag(key: str, tags: str = "tags", default: str = "") -> Column:
    return F.coalesce(F.try_element_at(F.col(tags), F.lit(key)), F.lit(default))


def has_tags(wanted: dict[str, str | list[str]], tags: str = "tags") -> Column:
    """Any of the keys holds (one of) its wanted value(s)."""
    tests = []
    for key, values in wanted.items():
        values = [values] if isinstance(values, str) else values
        tests.append(F.coalesce(F.try_element_at(F.col(tags), F.lit(key)).isin(values), F.lit(False)))
    return reduce(Column.__or__, tests)


def ways_to_rings(elements: DataFrame) -> DataFrame:
    """Ways with their corner coordinates in order: (id, tags, geometry as WKT)."""
    nodes = elements.where("type = 'node' and lat is not null").select(
        F.col("id").alias("node"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon")
    ).dropDuplicates(["node"])
    corners = (
        elements.where("type = 'way'")
        .select("id", F.posexplode("nodes").alias("pos", "node"))
        .distinct()
        .join(nodes, "node")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "nlon", "nlat"))).alias("ring"))
    )
    text = F.array_join(
        F.transform(
            "ring", lambda c: F.concat(c["nlon"].cast("string"), F.lit(" "), c["nlat"].cast("string"))
        ),
        ", ",
    )
    first, last = F.element_at("ring", 1), F.element_at("ring", -1)
    closed = (F.size("ring") > 3) & (first["nlon"] == last["nlon"]) & (first["nlat"] == last["nlat"])
    shape = (
        F.when(closed, F.concat(F.lit("POLYGON (("), text, F.lit("))")))
        .when(F.size("ring") > 1, F.concat(F.lit("LINESTRING ("), text, F.lit(")")))
        .otherwise(F.concat(F.lit("POINT ("), text, F.lit(")")))
    )
    tags = elements.where("type = 'way'").dropDuplicates(["id"]).select("id", "tags")
    return tags.join(corners, "id").select("id", "tags", shape.alias("geometry"))


def poi_table(elements: DataFrame, tags: dict = POI_TAGS) -> DataFrame:
    """(poi_id, category, name, geometry, tags, lat, lon) of every element a tag rule selects.

    Schools are split into the public and the private category by name.
    """
    point = F.concat(F.lit("POINT ("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    nodes = elements.where("type = 'node' and tags is not null and lat is not null").dropDuplicates(["id"]).select(
        "id", "tags", point.alias("geometry")
    )
    all_rows = nodes.withColumn("kind", F.lit("node")).unionByName(
        ways_to_rings(elements.where("type = 'node' or nodes is not null")).withColumn("kind", F.lit("way"))
    )
    labels = F.array_compact(F.array(*[F.when(has_tags(w), F.lit(c)) for c, w in tags.items()]))
    rows = all_rows.where("tags is not null").select("*", F.explode(labels).alias("category"))
    rows = rows.withColumn("name", F.try_element_at("tags", F.lit("name")))
    school = F.when(school_class(F.col("name")) == "publica", F.lit("escola_publicas")).otherwise(
        F.lit("escolas_privadas")
    )
    rows = rows.withColumn(
        "category", F.when(F.col("category") == "escola", school).otherwise(F.col("category"))
    ).withColumn("poi_id", F.concat_ws("/", "kind", F.col("id").cast("string")))
    return with_centroid(rows).select("poi_id", "category", "name", "geometry", "tags", "lat", "lon")
