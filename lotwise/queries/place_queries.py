"""Lookups, geometry, POI joins and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotwise.functions.geo import geometry_kind, standard_geometry, wkt_centroid
from lotwise.functions.scores import RADII, SCORES, count_name, distance_name, with_scores
from lotwise.operators.geocode import failed_addresses, lookup_status, resolve
from lotwise.operators.joins import pending_keys
from lotwise.operators.spatial import poi_features
from lotwise.queries.base import place_sql, query, r, rounded, table, with_place
from lotwise.sources.poi import has_tags, tag, ways_to_rings

CATEGORIES = list(RADII)


def _listings(spark, sf) -> DataFrame:
    return with_place(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "lat", "lon")


def _poi(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    return with_place(table(spark, sf, "supplier"), "s_suppkey").select(
        F.element_at(names, (F.col("s_nationkey") % 7 + 1).cast("int")).alias("category"), "lat", "lon"
    )


_PAIRS = f"""
    l AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer),
    p AS (SELECT s_nationkey % 7 AS cat, {place_sql('s_suppkey')} FROM supplier),
    d AS (SELECT c_custkey, cat, 2 * 6371000.0::double * asin(sqrt(least(1.0::double,
            pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2)))) AS metres
          FROM l CROSS JOIN p)"""
_DIST = ", ".join(f"min(metres) FILTER (cat = {i}) AS {distance_name(c)}" for i, c in enumerate(CATEGORIES))
_COUNT = ", ".join(
    f"count(*) FILTER (cat = {i} AND metres <= {RADII[c]}) AS {count_name(c, RADII[c])}" for i, c in enumerate(CATEGORIES)
)


@query(
    f"WITH {_PAIRS}, w AS (SELECT c_custkey, {_DIST} FROM d GROUP BY 1) SELECT c_custkey, "
    + ", ".join(f"round({distance_name(c)}, 3) AS {distance_name(c)}" for c in CATEGORIES)
    + " FROM w"
)
def nearest_poi(spark, sf):
    out = poi_features(_listings(spark, sf), _poi(spark, sf), wanted=("distance",))
    return out.select("c_custkey", *[r(distance_name(c), 3).alias(distance_name(c)) for c in CATEGORIES])


@query(f"WITH {_PAIRS} SELECT c_custkey, {_COUNT} FROM d GROUP BY 1")
def radius_counts(spark, sf):
    out = poi_features(_listings(spark, sf), _poi(spark, sf), wanted=("count",))
    return out.select("c_custkey", *[count_name(c, RADII[c]) for c in CATEGORIES])


_TWO_RADII = {c: [RADII[c], 3 * RADII[c]] for c in CATEGORIES}
_TWO_COUNTS = ", ".join(
    f"count(*) FILTER (cat = {i} AND metres <= {m}) AS {count_name(c, m)}"
    for i, c in enumerate(CATEGORIES) for m in _TWO_RADII[c]
)


@query(f"WITH {_PAIRS} SELECT c_custkey, {_TWO_COUNTS} FROM d GROUP BY 1")
def several_radii(spark, sf):
    """Two counts per category: its usual radius and three times that."""
    out = poi_features(_listings(spark, sf), _poi(spark, sf), _TWO_RADII, wanted=("count",))
    return out.select("c_custkey", *[count_name(c, m) for c in CATEGORIES for m in _TWO_RADII[c]])


_SCORE_SQL = ", ".join(
    f"{a}::double * exp(-{distance_name(c)} / {t}::double) + {b}::double * {count_name(c, RADII[c])} AS {s}"
    for s, (c, a, t, b) in SCORES.items()
)


@query(
    f"""WITH {_PAIRS}, w AS (SELECT c_custkey, {_DIST}, {_COUNT} FROM d GROUP BY 1), s AS (SELECT c_custkey, {_SCORE_SQL} FROM w)
    SELECT c_custkey, {', '.join(f'round({s}, 6) AS {s}' for s in SCORES)},
           round(score_escola_privada - 0.2::double * score_escola_publica, 6) + 0.0::double AS score_educacao FROM s"""
)
def proximity_scores(spark, sf):
    out = with_scores(poi_features(_listings(spark, sf), _poi(spark, sf)))
    return out.select("c_custkey", *[r(s, 6).alias(s) for s in [*SCORES, "score_educacao"]])


_SPREAD = (
    "-25.0::double - ((l_orderkey * 7919 + l_linenumber * 31) % 200003) / 1000000.0::double AS lat, "
    "-50.0::double - ((l_orderkey * 104729 + l_linenumber * 17) % 300007) / 1000000.0::double AS lon"
)


def _line_places(spark, sf, crowded: bool) -> DataFrame:
    """A place for every line of an order; if `crowded`, a third of them stand at one point."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    spread = {
        "lat": F.lit(-25.0) - ((k * 7919 + n * 31) % 200003) / F.lit(1000000.0),
        "lon": F.lit(-50.0) - ((k * 104729 + n * 17) % 300007) / F.lit(1000000.0),
    }
    point = {"lat": F.lit(-25.1), "lon": F.lit(-50.1)}
    here = {c: F.when((k + n) % 3 == 0, point[c]).otherwise(v) if crowded else v for c, v in spread.items()}
    return table(spark, sf, "lineitem").select(
        F.when(n <= 2, F.lit("mercado")).otherwise(F.lit("parque")).alias("category"), *[v.alias(c) for c, v in here.items()]
    )


def _line_sql(crowded: bool) -> str:
    at = """CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN -25.1::double ELSE lat END AS lat,
        CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN -50.1::double ELSE lon END AS lon""" if crowded else "lat, lon"
    metres = """2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin(radians(p.lat - l.lat) / 2), 2)
        + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2))))"""
    columns = ", ".join(
        f"round(min(metres) FILTER (cat = '{c}'), 3) AS {distance_name(c)}, "
        f"coalesce(sum(w) FILTER (cat = '{c}' AND metres <= {RADII[c]}), 0)::bigint AS {count_name(c, RADII[c])}"
        for c in ("mercado", "parque")
    )
    return f"""WITH s AS (SELECT *, {_SPREAD} FROM lineitem),
    p AS (SELECT CASE WHEN l_linenumber <= 2 THEN 'mercado' ELSE 'parque' END AS cat, {at} FROM s),
    q AS (SELECT cat, lat, lon, count(*) AS w FROM p GROUP BY ALL),
    l AS (SELECT s_suppkey, {place_sql('s_suppkey')} FROM supplier),
    d AS (SELECT s_suppkey, cat, w, {metres} AS metres FROM l CROSS JOIN q p)
    SELECT s_suppkey, {columns} FROM d GROUP BY 1"""


def _line_features(spark, sf, crowded: bool) -> DataFrame:
    homes = with_place(table(spark, sf, "supplier"), "s_suppkey").select("s_suppkey", "lat", "lon")
    out = poi_features(homes, _line_places(spark, sf, crowded), {c: RADII[c] for c in ("mercado", "parque")})
    names = [n for c in ("mercado", "parque") for n in (distance_name(c), count_name(c, RADII[c]))]
    return out.select("s_suppkey", *[r(n, 3).alias(n) if n.startswith("dist") else F.col(n) for n in names])


@query(_line_sql(False))
def dense_poi(spark, sf):
    """Places in the tens of thousands: the walk goes down several levels of cells."""
    return _line_features(spark, sf, False)


@query(_line_sql(True))
def crowded_poi(spark, sf):
    """The same with a third of all places at one point."""
    return _line_features(spark, sf, True)


def _digits(value, width: int = 4):
    return F.lpad(value.cast("string"), width, "0")


@query(
    """
    WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS shape, CAST((s_suppkey * 7919) % 2000 AS DOUBLE) AS a,
               CAST((s_suppkey * 104729) % 3000 AS DOUBLE) AS o FROM supplier)
    SELECT s_suppkey, CASE shape WHEN 0 THEN 'POINT' WHEN 1 THEN 'POLYGON' END AS kind,
           CASE shape WHEN 0 THEN round(-25 - a / 10000, 8) WHEN 1 THEN round(-25 - (a + 1) / 10000, 8) END AS lat,
           CASE shape WHEN 0 THEN round(-50 - o / 10000, 8) WHEN 1 THEN round(-50 - (o + 2) / 10000, 8) END AS lon,
           CASE WHEN shape < 2 THEN 'POINT' END AS kind_std FROM s
    """
)
def wkt_centroid_(spark, sf):
    k = F.col("s_suppkey")
    a, o = (k * 7919) % 2000, (k * 104729) % 3000

    def at(dx: int, dy: int):
        return F.concat(F.lit("-50."), _digits(o + dx), F.lit(" -25."), _digits(a + dy))

    point = F.concat(F.lit("POINT ("), at(0, 0), F.lit(")"))
    box = F.concat(
        F.lit("POLYGON (("), F.concat_ws(", ", at(0, 0), at(4, 0), at(4, 2), at(0, 2), at(0, 0)), F.lit("))")
    )
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(k % 3 == 0, point).when(k % 3 == 1, box).otherwise(F.lit("-25 -50")).alias("geometry")
    )
    rows = rows.withColumns({"c": wkt_centroid(F.col("geometry")), "std": standard_geometry(F.col("geometry"))})
    return rows.select(
        "s_suppkey",
        geometry_kind(F.col("geometry")).alias("kind"),
        r("c.lat", 8).alias("lat"),
        r("c.lon", 8).alias("lon"),
        geometry_kind(F.col("std")).alias("kind_std"),
    )


@query(
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS amenity FROM events
    WHERE event_type IN ('click', 'view') OR json_extract_string(props, '$.k') = '7'
    """
)
def tag_select(spark, sf):
    e = table(spark, sf, "events")
    tags = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("amenity"), F.col("event_type")))
    # generated, so that the text is parsed once for the test and for the columns
    rows = e.select("event_id", F.explode(F.array(tags)).alias("tags"))
    return rows.where(has_tags({"amenity": ["click", "view"], "k": "7"})).select(
        "event_id", tag("k").alias("k"), tag("amenity").alias("amenity")
    )


@query(
    """
    SELECT s_suppkey AS id, 5::bigint AS cantos, round(-25 - (CAST((s_suppkey * 7919) % 2000 AS DOUBLE) + 1) / 10000, 8) AS lat,
           round(-50 - (CAST((s_suppkey * 104729) % 3000 AS DOUBLE) + 1) / 10000, 8) AS lon FROM supplier
    """
)
def ring_assembly(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    a, o = (k * 7919) % 2000, (k * 104729) % 3000
    corners = [(0, 0), (2, 0), (2, 2), (0, 2)]
    nodes = s.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        (k * 4 + i).alias("id"),
                        F.concat(F.lit("-25."), _digits(a + dy)).cast("double").alias("lat"),
                        F.concat(F.lit("-50."), _digits(o + dx)).cast("double").alias("lon"),
                    )
                    for i, (dx, dy) in enumerate(corners)
                ]
            )
        ).alias("n")
    ).select(F.lit("node").alias("type"), "n.*")
    ways = s.select(
        F.lit("way").alias("type"),
        k.alias("id"),
        F.array(*[k * 4 + i for i in (0, 1, 2, 3, 0)]).alias("nodes"),
        F.create_map(F.lit("name"), F.col("s_name")).alias("tags"),
    )
    rings = ways_to_rings(nodes.unionByName(ways, allowMissingColumns=True))
    c = wkt_centroid(F.col("geometry"))
    return rings.select(
        "id",
        F.size(F.split("geometry", ",")).cast("long").alias("cantos"),
        r(c["lat"], 8).alias("lat"),
        r(c["lon"], 8).alias("lon"),
    )


_CASCADE = """
    a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE ' Rua ' || (o_custkey % 200) END AS rua,
                 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'Bairro ' || (o_custkey % 25) END AS bairro, o_custkey FROM orders),
    c1 AS (SELECT DISTINCT 'Rua ' || (c_custkey % 200) || ', Bairro ' || (c_custkey % 25) || ', Cidade' AS k,
             CASE WHEN c_custkey % 200 % 3 = 0 THEN NULL ELSE -25 - (c_custkey % 200) / 100.0::double END AS lat,
             CASE WHEN c_custkey % 200 % 3 = 0 THEN NULL ELSE -50 - (c_custkey % 25) / 100.0::double END AS lon
           FROM customer WHERE c_custkey % 200 % 5 <> 4),
    c2 AS (SELECT DISTINCT 'Rua ' || (c_custkey % 200) || ', Cidade' AS k,
             CASE WHEN c_custkey % 200 % 7 = 0 THEN NULL ELSE -26 - (c_custkey % 200) / 100.0::double END AS lat,
             CASE WHEN c_custkey % 200 % 7 = 0 THEN NULL ELSE -51.0::double END AS lon
           FROM customer WHERE c_custkey % 200 % 4 <> 1),
    c3 AS (SELECT 'Bairro ' || n_nationkey || ', Cidade' AS k, -27 - n_nationkey / 100.0::double AS lat, -52.0::double AS lon FROM nation)"""


def _addresses(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        "o_orderkey",
        F.when(key % 11 != 0, F.concat(F.lit(" Rua "), (cust % 200).cast("string"))).alias("rua"),
        F.when(key % 13 != 0, F.concat(F.lit("Bairro "), (cust % 25).cast("string"))).alias("bairro"),
    )


def _caches(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 200).alias("s"), (F.col("c_custkey") % 25).alias("b")
    )
    s, b = F.col("s"), F.col("b")
    known = s % 3 != 0
    full = c.where(s % 5 != 4).select(
        F.concat(F.lit("Rua "), s.cast("string"), F.lit(", Bairro "), b.cast("string"), F.lit(", Cidade")).alias("endereco_geo"),
        F.when(known, -25 - s / F.lit(100.0)).alias("lat"),
        F.when(known, -50 - b / F.lit(100.0)).alias("lon"),
    ).distinct()
    alt = c.where(s % 4 != 1).select(
        F.concat(F.lit("Rua "), s.cast("string"), F.lit(", Cidade")).alias("endereco_alt"),
        F.when(s % 7 != 0, -26 - s / F.lit(100.0)).alias("lat_alt"),
        F.when(s % 7 != 0, F.lit(-51.0)).alias("lon_alt"),
    ).distinct()
    area = table(spark, sf, "nation").select(
        F.concat(F.lit("Bairro "), F.col("n_nationkey").cast("string"), F.lit(", Cidade")).alias("endereco_bairro"),
        (-27 - F.col("n_nationkey") / F.lit(100.0)).alias("lat_bairro"),
        F.lit(-52.0).alias("lon_bairro"),
    )
    return full, alt, area


@query(
    f"""
    WITH {_CASCADE},
    j AS (SELECT a.*, coalesce(c1.lat, c2.lat) AS l2, coalesce(c1.lon, c2.lon) AS o2, c1.lat AS l1,
                 trim(rua) || ', ' || trim(bairro) || ', Cidade' AS cheia FROM a
          LEFT JOIN c1 ON trim(rua) || ', ' || trim(bairro) || ', Cidade' = c1.k
          LEFT JOIN c2 ON trim(rua) || ', Cidade' = c2.k),
    z AS (SELECT j.*, coalesce(l2, c3.lat) AS lat, coalesce(o2, c3.lon) AS lon, c3.lat AS l3 FROM j
          LEFT JOIN c3 ON j.l2 IS NULL AND bairro || ', Cidade' = c3.k)
    SELECT o_orderkey, CASE WHEN l2 IS NULL THEN bairro || ', Cidade' ELSE cheia END AS endereco_geo,
           round(lat, 6) AS lat, round(lon, 6) AS lon,
           CASE WHEN l1 IS NOT NULL THEN 'rua_bairro' WHEN l2 IS NOT NULL THEN 'rua' WHEN l3 IS NOT NULL THEN 'bairro' ELSE 'falhou' END AS geocode_stage,
           CASE WHEN lat IS NOT NULL AND rua IS NOT NULL AND bairro IS NOT NULL THEN 'rua_bairro' WHEN lat IS NOT NULL AND rua IS NOT NULL THEN 'rua'
                WHEN lat IS NOT NULL AND bairro IS NOT NULL THEN 'bairro' ELSE 'falhou' END AS nivel_geocoding FROM z
    """
)
def key_lookup_cascade(spark, sf):
    full, alt, area = _caches(spark, sf)
    out = resolve(_addresses(spark, sf), full, alt, area, suffix=("Cidade",))
    return rounded(out.drop("rua", "bairro"), 6, "lat", "lon")


@query(
    f"""
    WITH {_CASCADE}
    SELECT DISTINCT rua, bairro FROM a LEFT JOIN c1 ON trim(rua) || ', ' || trim(bairro) || ', Cidade' = c1.k
    WHERE lat IS NULL OR lon IS NULL
    """
)
def failed_address_pairs(spark, sf):
    full, _, _ = _caches(spark, sf)
    return failed_addresses(resolve(_addresses(spark, sf), full, suffix=("Cidade",)))


@query(
    """
    SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS chave FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
    """
)
def pending_keys_(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("chave"))
    cache = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("k"))
    return pending_keys(keys, "chave", cache, "k")


@query(
    """
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'erro' WHEN c_acctbal < 0 THEN 'nao_encontrado' ELSE 'sucesso' END AS status
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey
    """
)
def lookup_status_(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("chave"))
    cache = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(
        F.col("c_custkey").cast("string").alias("endereco_geo"),
        F.when(F.col("c_acctbal") >= 0, F.lit(-25.0)).alias("lat"),
        F.when(F.col("c_acctbal") >= 0, F.lit(-50.0)).alias("lon"),
    )
    return lookup_status(orders, "chave", cache).drop("chave")
