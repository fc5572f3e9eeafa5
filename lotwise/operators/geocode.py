"""Address keys resolved against lookup tables, with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions.text import geocode_key, short_key
from lotwise.operators.dedup import keep_first
from lotwise.operators.joins import lookup_join


def _from_cache(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Left join to a cache that may hold a key more than once."""
    return lookup_join(df, one_per_key(cache, key), [key], written=False)


def one_per_key(cache: DataFrame, key: str) -> DataFrame:
    """One row per key; a row with coordinates beats a failed lookup."""
    return keep_first(cache, [key], [F.col(cache.columns[1]).isNull(), *cache.columns[1:]])


def resolve(
    df: DataFrame,
    cache: DataFrame,
    alt_cache: DataFrame | None = None,
    area_cache: DataFrame | None = None,
    street: str = "rua",
    area: str = "bairro",
    suffix: tuple[str, ...] = (),
) -> DataFrame:
    """Coordinates by full address, then by street, and by neighbourhood if a third table is given.

    Adds endereco_geo, lat, lon, nivel_geocoding (from the columns present) and geocode_stage
    (the lookup that succeeded). Where everything failed the key becomes the neighbourhood key.
    Tables: cache(endereco_geo, lat, lon), alt_cache(endereco_alt, lat_alt, lon_alt),
    area_cache(endereco_bairro, lat_bairro, lon_bairro).
    """
    out = df.withColumn("endereco_geo", geocode_key(F.col(street), F.col(area), *suffix))
    out = _from_cache(out, cache, "endereco_geo")
    stage = F.when(F.col("lat").isNotNull(), F.lit("rua_bairro"))
    if alt_cache is not None:
        out = out.withColumn("endereco_alt", short_key(F.col(street), *suffix))
        out = _from_cache(out, alt_cache, "endereco_alt")
        stage = stage.when(F.col("lat_alt").isNotNull(), F.lit("rua"))
    out = out.withColumn("geocode_stage", stage)
    if alt_cache is not None:
        out = out.withColumns(
            {"lat": F.coalesce("lat", "lat_alt"), "lon": F.coalesce("lon", "lon_alt")}
        ).drop("lat_alt", "lon_alt", "endereco_alt")
    area_key = short_key(F.col(area), *suffix, trimmed=False)
    out = out.withColumn(
        "endereco_geo", F.when(F.col("lat").isNull(), area_key).otherwise(F.col("endereco_geo"))
    )
    if area_cache is not None:
        out = out.withColumn("endereco_bairro", F.when(F.col("lat").isNull(), area_key))
        out = _from_cache(out, area_cache, "endereco_bairro")
        found = F.col("geocode_stage").isNull() & F.col("lat_bairro").isNotNull()
        out = out.withColumns(
            {
                "geocode_stage": F.when(found, F.lit("bairro")).otherwise(F.col("geocode_stage")),
                "lat": F.coalesce("lat", "lat_bairro"),
                "lon": F.coalesce("lon", "lon_bairro"),
            }
        ).drop("lat_bairro", "lon_bairro", "endereco_bairro")
    return out.withColumns(
        {
            "geocode_stage": F.coalesce("geocode_stage", F.lit("falhou")),
            "nivel_geocoding": geocode_level(F.col("lat"), F.col(street), F.col(area)),
        }
    )


def geocode_level(lat: Column, street: Column, area: Column) -> Column:
    """Quality label from which of coordinates, street and neighbourhood are present."""
    ok = lat.isNotNull()
    return (
        F.when(ok & street.isNotNull() & area.isNotNull(), F.lit("rua_bairro"))
        .when(ok & street.isNotNull(), F.lit("rua"))
        .when(ok & area.isNotNull(), F.lit("bairro"))
        .otherwise(F.lit("falhou"))
    )


def failed_addresses(df: DataFrame, street: str = "rua", area: str = "bairro") -> DataFrame:
    """Distinct (street, neighbourhood) pairs whose coordinates are incomplete."""
    return df.where(F.col("lat").isNull() | F.col("lon").isNull()).select(street, area).distinct()


def lookup_status(df: DataFrame, key: str, cache: DataFrame, cache_key: str = "endereco_geo") -> DataFrame:
    """sucesso / nao_encontrado (looked up, no hit) / erro (never looked up) per row."""
    known = one_per_key(cache, cache_key).select(
        F.col(cache_key).alias(key), F.col("lat").alias("_lat"), F.lit(True).alias("_known")
    )
    status = (
        F.when(F.col("_lat").isNotNull(), F.lit("sucesso"))
        .when(F.col("_known"), F.lit("nao_encontrado"))
        .otherwise(F.lit("erro"))
    )
    return lookup_join(df, known, [key], written=False).withColumn("status", status).drop("_lat", "_known")
