"""Page files written out and read back, empty categories, chosen geometries and ordered model columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from lotwise.functions.geo import with_centroid
from lotwise.functions.scores import RADII, count_name, distance_name
from lotwise.functions.text import page_number
from lotwise.operators.filters import ordered_features
from lotwise.operators.spatial import poi_features
from lotwise.queries.base import place_sql, query, r, table, with_place
from lotwise.schemas import RAW_LISTINGS
from lotwise.session import shared_folder
from lotwise.sources import files
from lotwise.sources.poi import has_tags, read_responses, tag

_LISTED = """l AS (SELECT 'R$ ' || c_custkey AS preco, c_name || ', "n" ' || c_mktsegment AS endereco, abs(c_acctbal) AS area_m2,
    'u' || CAST(floor(c_custkey / 3) AS BIGINT) AS link, 'c' || (CAST(floor(c_custkey / 3) AS BIGINT) % 2) AS cidade,
    CAST(c_custkey % 3 AS INT) AS pagina FROM customer)"""


def _page_rows(spark, sf) -> DataFrame:
    """Customers seen as listings: every link stands on several pages of one city."""
    k = F.col("c_custkey")
    group = F.floor(k / 3)
    return table(spark, sf, "customer").select(
        F.concat(F.lit("R$ "), k.cast("string")).alias("preco"), F.col("c_name").alias("rua"),
        F.concat("c_name", F.lit(', "n" '), "c_mktsegment").alias("endereco"), (k % 5).cast("double").alias("quartos"),
        F.lit(None).cast("double").alias("banheiros"), F.abs("c_acctbal").alias("area_m2"),
        F.concat(F.lit("u"), group.cast("string")).alias("link"),
        F.concat(F.lit("c"), (group % 2).cast("string")).alias("cidade"), F.lit("pr").alias("estado"),
        F.lit("2026-02-09 08:00:00").alias("data_coleta"), (k % 3).cast("int").alias("pagina"),
    )


def _page_folder(spark, sf) -> str:
    """A folder of page files of two cities with three pages each, named by city, state and page."""
    rows, folder = _page_rows(spark, sf), shared_folder(spark, "page-files")
    for city in ("c0", "c1"):
        for page in range(3):
            mine = rows.where((F.col("cidade") == city) & (F.col("pagina") == page)).select(*RAW_LISTINGS.fieldNames())
            named = mine.write.mode("append").option("mapreduce.output.basename", f"{city}_pr_pagina{page}")
            named.option("header", True).option("escape", '"').csv(folder)
    return folder


@query(f"WITH {_LISTED} SELECT link, pagina, preco, endereco, area_m2 FROM l WHERE cidade = 'c1'")
def city_pages(spark, sf):
    """The page files of one city, found by their names."""
    return files.read_pages(spark, _page_folder(spark, sf), "c1", "pr").select("link", "pagina", "preco", "endereco", "area_m2")


@query(
    f"""WITH {_LISTED} SELECT link, cidade, preco, endereco, area_m2 FROM l
    QUALIFY row_number() OVER (PARTITION BY link ORDER BY pagina) = 1"""
)
def united_pages(spark, sf):
    """All page files united, each link from its first page."""
    return files.read_listings(spark, _page_folder(spark, sf)).select("link", "cidade", "preco", "endereco", "area_m2")


@query(
    f"""WITH {_LISTED} SELECT pagina, count(*) AS n_rows, CAST(0 AS BIGINT) AS bad_rows, count(link) AS links
    FROM l GROUP BY pagina"""
)
def page_file_report(spark, sf):
    """Rows, unreadable rows and links of the page files, added up per page."""
    report = files.file_report(spark, _page_folder(spark, sf))
    return report.groupBy(page_number(F.col("file_name")).alias("pagina")).agg(
        F.sum("rows").alias("n_rows"), F.sum("bad_rows").alias("bad_rows"), F.sum("links").alias("links")
    )


def _rename(spark, folder: str, start: str, ending: str) -> None:
    """The files of a folder whose names begin so get another ending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{start}*")):
        fs.rename(status.getPath(), status.getPath().suffix(ending))


@query(
    """
    WITH l AS (SELECT *, CAST(c_custkey % 4 AS INT) AS pagina FROM customer)
    SELECT pagina, 'bad row' AS reason, 'R$ ' || c_custkey || ',Rua,x,muitos,1.0,1.0,u' || c_custkey || ',c,pr,2026-02-09 08:00:00' AS "row"
    FROM l WHERE c_custkey % 50 = 3 AND pagina <> 2
    UNION ALL SELECT 2, 'unreadable', NULL
    """
)
def quarantined_files(spark, sf):
    """Page files of which one is no compressed file though it is named so, and some rows have a word for a number."""
    k, folder = F.col("c_custkey"), shared_folder(spark, "broken-pages")
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("R$ "), k.cast("string")).alias("preco"), F.lit("Rua").alias("rua"), F.lit("x").alias("endereco"),
        F.when(k % 50 == 3, "muitos").otherwise("1.0").alias("quartos"), F.lit("1.0").alias("banheiros"), F.lit("1.0").alias("area_m2"),
        F.concat(F.lit("u"), k.cast("string")).alias("link"), F.lit("c").alias("cidade"), F.lit("pr").alias("estado"),
        F.lit("2026-02-09 08:00:00").alias("data_coleta"), k,
    )
    for page in range(4):
        mine = rows.where(k % 4 == page).drop("c_custkey").coalesce(1)
        named = mine.write.mode("append").option("mapreduce.output.basename", f"c_pr_pagina{page}")
        named.option("header", True).csv(folder)
    _rename(spark, folder, "c_pr_pagina2", ".gz")
    found = files.quarantine(spark, folder)
    return found.select(page_number(F.col("file_name")).alias("pagina"), "reason", "row")


@query(f"WITH {_LISTED} SELECT link, pagina, preco, endereco, area_m2 FROM l")
def united_file(spark, sf):
    """The united table written under its derived name and scanned with a declared schema."""
    rows = _page_rows(spark, sf).select("link", "pagina", "preco", "endereco", "area_m2")
    path = files.write_united(rows, shared_folder(spark, "united"))
    return files.scan_csv(spark, path, StructType([*rows.schema.fields])).select(*rows.columns)


_HERE, _NONE = "hospital", "policia"


@query(
    f"""WITH l AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), p AS (SELECT {place_sql('s_suppkey')} FROM supplier),
    d AS (SELECT c_custkey, 2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(p.lat - l.lat) / 2), 2)
        + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2)))) AS metres FROM l CROSS JOIN p)
    SELECT c_custkey, round(min(metres), 3) AS {distance_name(_HERE)}, count(*) FILTER (metres <= {RADII[_HERE]}) AS {count_name(_HERE, RADII[_HERE])},
        CAST(NULL AS DOUBLE) AS {distance_name(_NONE)}, CAST(0 AS BIGINT) AS {count_name(_NONE, RADII[_NONE])} FROM d GROUP BY 1"""
)
def empty_category(spark, sf):
    """A category without any place: no distance, a count of zero."""
    places = with_place(table(spark, sf, "supplier"), "s_suppkey").select(F.lit(_HERE).alias("category"), "lat", "lon")
    homes = with_place(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "lat", "lon")
    out = poi_features(homes, places, {c: RADII[c] for c in (_HERE, _NONE)})
    return out.select(
        "c_custkey", r(distance_name(_HERE), 3).alias(distance_name(_HERE)), count_name(_HERE, RADII[_HERE]),
        distance_name(_NONE), count_name(_NONE, RADII[_NONE]),
    )


@query(
    """SELECT o_orderkey, given, CAST(CASE given WHEN 'plain' THEN y WHEN 'standard' THEN y + 1 ELSE 7 END AS DOUBLE) AS lat,
        CAST(CASE given WHEN 'plain' THEN x WHEN 'standard' THEN x + 1 ELSE 8 END AS DOUBLE) AS lon
    FROM (SELECT o_orderkey, o_orderkey % 170 - 85 AS x, o_orderkey % 80 - 40 AS y, unnest(['plain', 'standard', 'both']) AS given FROM orders)"""
)
def chosen_geometry(spark, sf):
    """Coordinates are derived only where they are absent, and rather from the standard geometry."""
    k = F.col("o_orderkey")

    def point(shift: int):
        x, y = ((k % m - m // 2 + shift).cast("string") for m in (170, 80))
        return F.concat(F.lit("POINT ("), x, F.lit(" "), y, F.lit(")"))

    plain = table(spark, sf, "orders").select("o_orderkey", point(0).alias("geometry"))
    standard = plain.withColumn("geometry_std", point(1))
    both = standard.withColumns({"lat": F.lit(7.0), "lon": F.lit(8.0)})
    found = [
        with_centroid(df).select("o_orderkey", F.lit(name).alias("given"), "lat", "lon")
        for name, df in (("plain", plain), ("standard", standard), ("both", both))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    f"""SELECT 's' || s_suppkey AS nome, s_suppkey AS id, lat, lon, CASE s_suppkey % 3 WHEN 0 THEN 'hospital' WHEN 1 THEN 'school' ELSE 'bar' END AS amenity
    FROM (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier) WHERE s_suppkey % 3 <> 2"""
)
def response_elements(spark, sf):
    """Saved responses, one document a nation, read back and filtered by their tags."""
    k = F.col("s_suppkey")
    amenity = F.when(k % 3 == 0, "hospital").when(k % 3 == 1, "school").otherwise("bar")
    element = F.struct(
        F.lit("node").alias("type"), k.alias("id"), "lat", "lon",
        F.create_map(F.lit("amenity"), amenity, F.lit("name"), F.concat(F.lit("s"), k.cast("string"))).alias("tags"),
    )
    docs = with_place(table(spark, sf, "supplier"), "s_suppkey").groupBy("s_nationkey").agg(F.collect_list(element).alias("elements"))
    folder = shared_folder(spark, "responses")
    docs.select("s_nationkey", F.lit(0.6).alias("version"), F.lit("g").alias("generator"), "elements").write.partitionBy("s_nationkey").json(folder)
    found = read_responses(spark, folder).where(has_tags({"amenity": ["hospital", "school"]}))
    return found.select(tag("name").alias("nome"), "id", "lat", "lon", tag("amenity").alias("amenity"))


@query(
    """SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(NULL AS DOUBLE) AS ausente,
        l_returnflag, CAST(NULL AS VARCHAR) AS falta FROM lineitem"""
)
def model_columns(spark, sf):
    """The wanted columns in order and type; absent ones are null."""
    return ordered_features(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "ausente"], ["l_returnflag", "falta"])
