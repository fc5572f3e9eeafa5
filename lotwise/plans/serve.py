"""New listings in, prices out: address key, coordinates, POI features, scores, price, append."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from lotwise.functions.scores import RADII, with_scores
from lotwise.functions.text import geocode_key
from lotwise.operators.filters import minimum_address
from lotwise.operators.geocode import lookup_status, one_per_key
from lotwise.operators.joins import lookup_join
from lotwise.operators.spatial import poi_features
from lotwise.plans.score import score
from lotwise.session import cut_lineage, spread
from lotwise.sources.predictions import append_predictions, prediction_rows

COUNTRY = "Brasil"


def with_status(new: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds the address key, as the batch path builds it, and `status`: sem_endereco (no street, neighbourhood, city or
    state), sucesso, nao_encontrado or erro."""
    key = geocode_key(F.col("rua"), F.col("bairro"), F.col("cidade"), F.col("estado"), COUNTRY)
    keyed = new.withColumn("endereco_geo", F.when(minimum_address(), key))
    found = lookup_status(keyed, "endereco_geo", cache)
    return found.withColumn("status", F.when(F.col("endereco_geo").isNull(), F.lit("sem_endereco")).otherwise(F.col("status")))


def price_new_listings(
    new: DataFrame,
    cache: DataFrame,
    poi: DataFrame,
    model: PipelineModel,
    model_name: str,
    version: str,
    table: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(priced rows, rows without coordinates and their status); priced rows are appended to `table`.

    Listings are spread, and written once with their status and once with their place: each table is read more than once.
    """
    checked = cut_lineage(with_status(spread(new), cache), "checked")
    places = one_per_key(cache, "endereco_geo")
    good = lookup_join(checked.where("status = 'sucesso'"), places, ["endereco_geo"], written=False)
    good = cut_lineage(good, "placed")
    featured = with_scores(poi_features(good, poi, RADII)).drop("score_educacao")
    priced = score(model, featured, missing="zero", model_name=model_name, version=version)
    if table is not None:
        append_predictions(prediction_rows(priced, model_name, version), table)
    return priced, checked.where("status <> 'sucesso'")
