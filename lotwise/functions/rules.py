"""Keyword classes and bands, kept as data and turned into CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ordered keyword rules for the property class.
TYPE_RULES = [
    ("terreno", ["terreno", "lote"]),
    ("apartamento", ["apartamento", "cobertura", "duplex", "flat", "kitnet"]),
    ("casa", ["casa", "sobrado", "vila"]),
    ("comercial", ["comercial", "loja", "box", "galpão", "deposito", "depósito", "sala", "conjunto"]),
    ("predio", ["prédio", "edificio", "edifício"]),
]
TYPE_DEFAULT = "outros"

# Name parts that mark a public school.
PUBLIC_SCHOOL_PARTS = [
    "municipal", "estadual", "federal", "instituto federal", "colégio estadual",
    "escola municipal", "cmei", "emei", "emef", "eef", "eeef", "universidade federal",
    "universidade estadual", "ifpr", "ifsp", "ifsc", "ifrs",
]

# Upper band edges in square metres and the band names in order.
AREA_EDGES = [50.0, 80.0, 120.0, 200.0, 400.0]
AREA_LABELS = ["Até 50", "50–80", "80–120", "120–200", "200–400", "400+"]

# Property types that take part in a model.
VALID_TYPES = ["casa", "apartamento", "comercial"]


def contains_any(text: Column, parts: list[str]) -> Column:
    test = F.lit(False)
    for part in parts:
        test = test | F.contains(text, F.lit(part))
    return test


def classify(text: Column, rules=TYPE_RULES, default: str = TYPE_DEFAULT) -> Column:
    """First rule with a matching substring wins; null falls to the default."""
    lowered = F.lower(text)
    case = None
    for label, parts in rules:
        test = contains_any(lowered, parts)
        case = F.when(test, F.lit(label)) if case is None else case.when(test, F.lit(label))
    return case.otherwise(F.lit(default))


def school_class(name: Column, parts=PUBLIC_SCHOOL_PARTS) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    return F.when(contains_any(lowered, parts), F.lit("publica")).otherwise(F.lit("privada"))


def _ladder(area: Column, case) -> Column:
    for edge, label in zip(AREA_EDGES, AREA_LABELS):
        case = case.when(area <= F.lit(edge), F.lit(label)) if case is not None else F.when(
            area <= F.lit(edge), F.lit(label)
        )
    return case


def area_band(area: Column) -> Column:
    """Right-closed bands; null for null, NaN, zero and negative areas."""
    missing = area.isNull() | F.isnan(area.cast("double")) | (area <= 0)
    return _ladder(area, F.when(missing, F.lit(None).cast("string"))).otherwise(F.lit(AREA_LABELS[-1]))


def scoring_band(area: Column, given: Column | None = None) -> Column:
    """Band used when scoring: plain '<=' ladder, a missing number falls to the last band."""
    value = F.nanvl(area.cast("double"), F.lit(None).cast("double"))
    band = F.when(value.isNull(), F.lit(AREA_LABELS[-1])).otherwise(
        _ladder(value, None).otherwise(F.lit(AREA_LABELS[-1]))
    )
    return band if given is None else F.coalesce(given, band)


def band_order(band: Column) -> Column:
    case = None
    for position, label in enumerate(AREA_LABELS):
        test = band == F.lit(label)
        case = F.when(test, F.lit(position)) if case is None else case.when(test, F.lit(position))
    return case
