"""Row predicates, validation and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.functions.numeric import inf_to_null
from lotwise.functions.rules import VALID_TYPES

DISTANCE_LIMIT_M = 100_000


def has_coordinates() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def geocode_failed() -> Column:
    return F.col("lat").isNull() | F.col("lon").isNull()


def valid_types(col: str = "tipo_imovel_cat", types: list[str] | None = None) -> Column:
    return F.col(col).isin(types or VALID_TYPES)


def reachable(cols: list[str], limit: float = DISTANCE_LIMIT_M) -> Column:
    """The largest non-null distance is below the limit; a row without any fails."""
    largest = F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    return F.coalesce(largest < limit, F.lit(False))


def within_reach(df: DataFrame, cols: list[str], limit: float = DISTANCE_LIMIT_M) -> DataFrame:
    return df.where(reachable(cols, limit))


def finite(cols: list[str]) -> Column:
    """No column is null, NaN or infinite."""
    return reduce(Column.__and__, [inf_to_null(F.col(c).cast("double")).isNotNull() for c in cols])


def finite_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinite values become null, then rows with any null in the columns go."""
    return df.withColumns({c: inf_to_null(F.col(c).cast("double")) for c in cols}).dropna(subset=cols)


def substring_share(col: str, part: str) -> Column:
    return F.avg(F.contains(F.col(col), F.lit(part)).cast("double"))


def without_last(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows but the one that comes last in the given order."""
    last = df.agg(F.max(F.struct(*order)).alias("m"))
    return df.where(F.struct(*order) < last.scalar())


# Fixed values: (field, minimum, minimum is allowed, maximum) of a scoring request.
REQUEST_RULES = [
    ("quartos", 0, True, 20),
    ("banheiros", 0, True, 20),
    ("vagas_garagem", 0, True, 20),
    ("area_m2", 0, False, 10_000),
]
SCORE_FIELDS = [
    "score_escola_privada", "score_escola_publica", "score_hospitais", "score_mercado",
    "score_farmacia", "score_parque", "score_seguranca",
]
REQUIRED_FIELDS = ["quartos", "banheiros", "area_m2", "bairro"]
ZERO_DEFAULTS = ["vagas_garagem", *SCORE_FIELDS]


def with_violations(
    df: DataFrame,
    rules=REQUEST_RULES,
    required: list[str] | None = None,
    not_negative: list[str] | None = None,
) -> DataFrame:
    """Add `violations`, the names of all broken rules."""
    required = REQUIRED_FIELDS if required is None else required
    not_negative = SCORE_FIELDS if not_negative is None else not_negative
    found = []
    for field in required:
        found.append(F.when(F.col(field).isNull(), F.lit(f"{field}:missing")))
    for field, low, closed, high in rules:
        below = F.col(field) < low if closed else F.col(field) <= low
        found.append(F.when(below, F.lit(f"{field}:low")))
        found.append(F.when(F.col(field) > high, F.lit(f"{field}:high")))
    for field in not_negative:
        found.append(F.when(F.col(field) < 0, F.lit(f"{field}:low")))
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def split_valid(df: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = with_violations(df, **rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def minimum_address(street: str = "rua", area: str = "bairro") -> Column:
    """Street and neighbourhood are both present and not blank."""
    return reduce(
        Column.__and__, [F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in (street, area)]
    )


def ordered_features(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """The model columns in order; absent ones are added as null."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in numeric]
    cols += [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in text]
    return df.select(*cols)
