"""From raw listing rows to the training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotwise.functions import numeric, rules, text
from lotwise.functions.scores import with_scores
from lotwise.operators.filters import valid_types
from lotwise.operators.geocode import resolve
from lotwise.operators.spatial import poi_features
from lotwise.operators.transformers import fill_with_medians

# Model columns and target.
NUM_FEATURES = [
    "quartos", "banheiros", "vagas_garagem", "area_m2",
    "score_escola_privada", "score_escola_publica", "score_hospitais", "score_mercado",
    "score_farmacia", "score_parque", "score_seguranca",
]
CAT_FEATURES = ["bairro", "faixa_area"]
TARGET = "log_preco"


def parse_listings(raw: DataFrame) -> DataFrame:
    """Raw text columns to numbers: parking, neighbourhood, type, price, price per m2."""
    address = F.col("endereco")
    parsed = raw.withColumns(
        {
            "vagas_garagem": text.parking_spots(address),
            "bairro": text.neighbourhood(address),
            "tipo_imovel": text.property_type(address),
            "preco_rejeitado": text.money_rejected(F.col("preco")),
            "preco": text.money(F.col("preco")),
        }
    )
    return parsed.withColumn("preco_m2", numeric.price_per_area(F.col("preco"), F.col("area_m2")))


def enrich(parsed: DataFrame, cache, alt_cache, poi: DataFrame, suffix: tuple[str, ...], area_cache=None) -> DataFrame:
    """Coordinates from the lookup tables, then POI distances and counts; rows without coordinates go."""
    placed = resolve(parsed, cache, alt_cache, area_cache, suffix=suffix)
    return poi_features(placed.dropna(subset=["lat", "lon"]), poi)


def prepare(df: DataFrame, types: list[str] | None = None, fill: bool = True) -> DataFrame:
    """Scores, type class, type filter, area band, log target and (optionally) median fill.

    The band is set before filling and stays null where the area was missing. With fill=False the
    gaps are left to the imputer that is fitted on the training part only.
    """
    out = df.drop("Unnamed: 0", "_c0")
    out = with_scores(out).withColumn("tipo_imovel_cat", rules.classify(F.col("tipo_imovel")))
    out = out.where(valid_types(types=types)).withColumns(
        {"faixa_area": rules.area_band(F.col("area_m2")), TARGET: numeric.log_target(F.col("preco"))}
    )
    return fill_with_medians(out) if fill else out
