"""Scoring of listing tables with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from lotwise.functions.numeric import price_from_log
from lotwise.functions.rules import area_band, scoring_band
from lotwise.operators.filters import ZERO_DEFAULTS
from lotwise.plans.prepare import CAT_FEATURES, NUM_FEATURES

CURRENCY = "BRL"


def with_defaults(df: DataFrame, missing: str = "impute") -> DataFrame:
    """'zero': absent scores and parking become 0; 'impute': they stay null for the fitted median."""
    if missing not in ("impute", "zero"):
        raise ValueError("missing is 'impute' or 'zero'")
    have = set(df.columns)
    out = df.withColumns({c: F.lit(None).cast("double") for c in NUM_FEATURES if c not in have})
    if missing == "zero":
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ZERO_DEFAULTS})
    return out


def with_band(df: DataFrame, rule: str = "scoring") -> DataFrame:
    """Fill a missing band from the area, by the scoring ladder or by the training bands."""
    given = F.col("faixa_area") if "faixa_area" in df.columns else F.lit(None).cast("string")
    if "area_m2" not in df.columns:
        return df.withColumn("faixa_area", F.coalesce(given, scoring_band(F.lit(0.0))))
    band = scoring_band(F.col("area_m2")) if rule == "scoring" else area_band(F.col("area_m2"))
    return df.withColumn("faixa_area", F.coalesce(given, band))


def score(
    model: PipelineModel,
    df: DataFrame,
    missing: str = "impute",
    band_rule: str = "scoring",
    model_name: str | None = None,
    version: str | None = None,
    keep_features: bool = False,
) -> DataFrame:
    """Input rows plus log_preco, preco_estimado, moeda (and model name and version)."""
    ready = with_defaults(with_band(df, band_rule), missing)
    ready = ready.withColumns({c: F.lit(None).cast("string") for c in CAT_FEATURES if c not in ready.columns})
    ready = ready.withColumn("_given", F.struct(*df.columns))
    out = model.transform(ready).withColumns(
        {
            "log_preco": F.col("prediction"),
            "preco_estimado": price_from_log(F.col("prediction")),
            "moeda": F.lit(CURRENCY),
        }
    )
    if model_name is not None:
        out = out.withColumns({"modelo": F.lit(model_name), "versao_modelo": F.lit(version)})
    added = ["log_preco", "preco_estimado", "moeda", *(["modelo", "versao_modelo"] if model_name else [])]
    kept = ["features"] if keep_features else []
    given = [c for c in df.columns if c not in added]
    return out.select(*[F.col("_given")[c].alias(c) for c in given], *kept, *added)
