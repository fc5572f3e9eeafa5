"""Proximity scores a*exp(-distance/tau) + b*count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# POI category -> search radius in metres.
RADII = {
    "escolas_privadas": 500,
    "escola_publicas": 500,
    "policia": 500,
    "hospital": 1000,
    "mercado": 500,
    "farmacia": 300,
    "parque": 1000,
}

# Score name -> (POI category, a, tau, b).
SCORES = {
    "score_escola_privada": ("escolas_privadas", 1.2, 600.0, 0.6),
    "score_escola_publica": ("escola_publicas", 0.6, 600.0, 0.2),
    "score_hospitais": ("hospital", 0.8, 1200.0, 0.4),
    "score_mercado": ("mercado", 1.0, 400.0, 0.4),
    "score_farmacia": ("farmacia", 0.6, 300.0, 0.2),
    "score_parque": ("parque", 1.2, 1200.0, 0.8),
    "score_seguranca": ("policia", 1.0, 1500.0, 0.3),
}
PUBLIC_SCHOOL_DISCOUNT = 0.2


def distance_name(category: str) -> str:
    return f"dist_{category}_mais_proximo"


def count_name(category: str, radius: int) -> str:
    return f"qtd_{category}_{radius}m"


def score(distance: Column, count: Column, a: float, tau: float, b: float) -> Column:
    return F.lit(a) * F.exp(-distance / F.lit(tau)) + F.lit(b) * count


def with_scores(df: DataFrame, radii: dict[str, int] = RADII) -> DataFrame:
    """The seven scores and the education score from the dist_*/qtd_* columns."""
    cols = {
        name: score(F.col(distance_name(cat)), F.col(count_name(cat, radii[cat])), a, tau, b)
        for name, (cat, a, tau, b) in SCORES.items()
    }
    return df.withColumns(cols).withColumn(
        "score_educacao",
        F.col("score_escola_privada") - F.lit(PUBLIC_SCHOOL_DISCOUNT) * F.col("score_escola_publica"),
    )
