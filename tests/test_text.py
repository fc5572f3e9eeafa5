import pytest
from pyspark.sql import functions as F

from lotwise.functions import numeric, rules, text

ADDRESSES = [
    ("Casa para comprar com 80 m², 2 quartos, 1 vaga emCentro, X", 1.0, "Centro", "Casa"),
    ("Sobrado para comprar com 90 m², 3 vagas em Jardim Sul, X", 3.0, "Jardim Sul", "Sobrado"),
    ("Imóvel comercial para alugar com 90 m² emVila Nova, X", None, "Vila Nova", None),
    ("Casa para comprar emImóvel Centro, X", None, "Centro", "Casa"),
    ("Casa para comprar, 2 vagas em Sul, X", 2.0, "Sul", "Casa"),
    (None, None, None, None),
]


def test_address_parts(spark):
    rows = spark.createDataFrame([(a[0],) for a in ADDRESSES], "e string")
    got = rows.select(
        text.parking_spots(F.col("e")), text.neighbourhood(F.col("e")), text.property_type(F.col("e"))
    ).collect()
    assert [tuple(r) for r in got] == [a[1:] for a in ADDRESSES]


@pytest.mark.parametrize(
    "given,value,rejected",
    [("R$ 350.000", 350000.0, False), ("R$ 1.234.567,89", 1234567.89, False), ("Sob consulta", None, True),
     (None, None, False), ("R$ 900", 900.0, False)],
)
def test_money(spark, given, value, rejected):
    row = spark.createDataFrame([(given,)], "p string").select(
        text.money(F.col("p")).alias("v"), text.money_rejected(F.col("p")).alias("r")
    ).first()
    assert (row["v"], row["r"]) == (value, rejected)


def test_money_label(spark):
    assert spark.range(1).select(text.money_label(F.lit(1234567.891))).first()[0] == "R$ 1,234,567.89"


CLASSES = {
    "Lote/Terreno": "terreno", "Cobertura": "apartamento", "Casa de Vila": "casa", "Sala/Conjunto": "comercial",
    "Galpão/Depósito": "comercial", "Prédio/Edifício inteiro": "predio", "Fazenda": "outros", None: "outros",
    "Terreno com casa": "terreno", "Casa duplex": "apartamento",
}


def test_type_class(spark):
    rows = spark.createDataFrame([(k,) for k in CLASSES], "t string").select("t", rules.classify(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in rows.collect()} == CLASSES


def test_school_class(spark):
    want = {"Escola Municipal A": "publica", "IFPR": "publica", "CMEI B": "publica", "Colégio Santa C": "privada", None: "privada"}
    rows = spark.createDataFrame([(k,) for k in want], "n string").select("n", rules.school_class(F.col("n")).alias("c"))
    assert {r["n"]: r["c"] for r in rows.collect()} == want


def test_bands(spark):
    nan = float("nan")
    cases = [
        (0.0, None, "Até 50"), (50.0, "Até 50", "Até 50"), (50.01, "50–80", "50–80"), (80.0, "50–80", "50–80"),
        (120.0, "80–120", "80–120"), (200.0, "120–200", "120–200"), (400.0, "200–400", "200–400"),
        (400.5, "400+", "400+"), (-1.0, None, "Até 50"), (nan, None, "400+"), (None, None, "400+"),
    ]
    rows = spark.createDataFrame([(c[0],) for c in cases], "a double").select(
        rules.area_band(F.col("a")), rules.scoring_band(F.col("a"))
    )
    assert [tuple(r) for r in rows.collect()] == [c[1:] for c in cases]


def test_numbers(spark):
    row = spark.sql("select 2.5D a, 3.5D b, cast(null as double) c, 0D d").select(
        numeric.half_even_long(F.col("a")), numeric.half_even_long(F.col("b")), numeric.log_target(F.col("c")),
        numeric.log_target(F.col("d")), numeric.price_per_area(F.col("a"), F.col("d")), numeric.clip(F.col("c"), 0.0, 1.0),
    ).first()
    assert tuple(row) == (2, 4, None, 0.0, None, None)


def test_keys_and_pages(spark):
    row = spark.sql("select ' Rua A ' r, cast(null as string) n, 'Centro' b").select(
        text.geocode_key(F.col("r"), F.col("b"), "C", "PR"), text.geocode_key(F.col("r"), F.col("n"), "C"),
        text.short_key(F.col("r"), "C"), text.page_number(F.lit("x_pr_pagina12.csv")), text.page_number(F.lit("x.csv")),
    ).first()
    assert tuple(row) == ("Rua A, Centro, C, PR", None, "Rua A, C", 12, 0)


def test_title_starts_after_any_other_character(spark):
    from lotwise.functions.text import title

    words = ["ponta-grossa", "SÃO josé d'oeste", "", None, "2a via"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(title(F.col("w"))).collect()] == [w if w is None else w.title() for w in words]


def test_all_named_characters(spark):
    from lotwise.sources.html import decode_entities

    df = spark.createDataFrame([("a &ndash; b &euro; &rsquo; &eacute; &nosuch;",)], "w string")
    assert df.select(decode_entities(F.col("w"))).first()[0] == "a – b € ’ é &nosuch;"
