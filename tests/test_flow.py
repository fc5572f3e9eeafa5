"""Raw page rows all the way to stored predictions."""

import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lotwise.functions.scores import RADII
from lotwise.operators import models
from lotwise.plans.prepare import NUM_FEATURES, enrich, parse_listings, prepare
from lotwise.plans.serve import price_new_listings
from lotwise.plans.train import fit_full
from lotwise.sources.files import read_listings
from lotwise.schemas import RAW_LISTINGS
from lotwise.sources.predictions import read_predictions

KINDS = ["Casa", "Apartamento", "Sala/Conjunto", "Lote/Terreno"]
PLACE = ("Cidade", "PR", "Brasil")


@pytest.fixture(scope="module")
def raw(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for page in range(1, 5):
        rows = []
        for i in range(60):
            n = page * 60 + i
            deal = "alugar" if n % 20 == 0 else "comprar"
            text = f"{KINDS[n % 4]} para {deal} com {30 + n} m², {n % 4} quartos, {n % 3} vagas emBairro {n % 5}, Cidade"
            price = "Sob consulta" if n % 50 == 7 else f"R$ {100 + n}.000"
            street = "" if n % 11 == 0 else f"Rua {n % 12}"
            rows.append(f'{price},{street},"{text}",{n % 4}.0,1.0,{30 + n}.0,u{n},c,pr,2026-02-09 08:00:00')
        with open(f"{folder}/c_pr_pagina{page}.csv", "w", encoding="utf-8") as f:
            f.write("\n".join([",".join(RAW_LISTINGS.fieldNames()), *rows]) + "\n")
    return read_listings(spark, folder)


@pytest.fixture(scope="module")
def lookups(spark):
    full = [(f"Rua {s}, Bairro {b}, Cidade, PR, Brasil", -25.0 - s / 500, -50.0 - b / 500) for s in range(12) for b in range(5) if s % 4]
    alt = [(f"Rua {s}, Cidade, PR, Brasil", -25.0 - s / 500, -50.0) for s in range(0, 12, 4)]
    poi = [(c, -25.0 - i / 400, -50.0 - i / 600) for c in RADII for i in range(6)]
    return (
        spark.createDataFrame(full, "endereco_geo string, lat double, lon double"),
        spark.createDataFrame(alt, "endereco_alt string, lat_alt double, lon_alt double"),
        spark.createDataFrame(poi, "category string, lat double, lon double"),
    )


def test_raw_to_predictions(spark, raw, lookups):
    cache, alt, poi = lookups
    parsed = parse_listings(raw)
    assert parsed.count() == 240
    assert parsed.where("preco_rejeitado").count() == raw.where("preco = 'Sob consulta'").count() > 0
    homes = enrich(parsed, cache, alt, poi, PLACE).persist()
    # Only rows without a street have nothing to look up.
    assert homes.count() == raw.where("rua is not null").count()
    assert homes.where(F.col("dist_parque_mais_proximo").isNull()).count() == 0
    filled = prepare(homes)
    assert filled.where("tipo_imovel_cat not in ('casa', 'apartamento', 'comercial')").count() == 0
    assert filled.where("tipo_imovel is null").count() == 0  # rentals have no type and are dropped
    assert filled.where("log_preco is null or preco is null").count() == 0
    table = prepare(homes, fill=False).where("log_preco is not null")
    model = fit_full(table, models.linear(table, "log_preco"), "log_preco", NUM_FEATURES, ["bairro", "faixa_area"])
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    new = spark.createDataFrame(
        [("Rua 1", "Bairro 1", 80.0), ("Rua 4", "Bairro 1", 80.0), (" ", "Bairro 1", 80.0)], "rua string, bairro string, area_m2 double"
    ).withColumns({"cidade": F.lit("Cidade"), "estado": F.lit("PR"), "quartos": F.lit(2), "banheiros": F.lit(1), "vagas_garagem": F.lit(1)})
    priced, aside = price_new_listings(new, cache, poi, model, "m", "1.0.0", folder)
    assert priced.count() == 1 and priced.first()["moeda"] == "BRL"
    assert sorted(r["status"] for r in aside.collect()) == ["erro", "sem_endereco"]
    row = read_predictions(spark, folder).first()
    assert (row["modelo"], row["versao_modelo"], row["cidade"]) == ("m", "1.0.0", "Cidade")
    assert row["preco_predito"] == priced.first()["preco_estimado"] > 0


def test_comparison_saves_its_best(spark):
    rows = spark.range(300).select(
        "id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        ((F.col("id") % 17) * 3 + (F.col("id") % 5)).cast("double").alias("y"),
    )
    board = models.ModelComparison(rows, "y", ["a", "b"], ["id"]).prepare().fit_all(
        {"linear": models.linear, "ridge": lambda d, t: models.ridge(d, t, 50.0)}
    )
    assert board.report().first()["model"] == "linear"
    path = board.keep_winner(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "run1")
    board.close()
    assert path.endswith("/run1")
    again = PipelineModel.load(path).transform(rows)
    assert again.where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count() == 0


def test_listings_are_read_once(spark, lookups):
    """Status, places and prices come from written tables; rows of one task are spread first."""
    cache, _, poi = lookups
    homes = spark.range(60).select(
        *[(F.col("id") % (k + 2)).cast("double").alias(c) for k, c in enumerate(NUM_FEATURES)], F.col("id").cast("double").alias("log_preco")
    )
    model = fit_full(homes, models.linear(homes, "log_preco"), "log_preco", NUM_FEATURES, [])
    read = spark.sparkContext.accumulator(0)

    def street(k):
        read.add(1)
        return f"Rua {k % 12}"

    n = 25_000
    new = spark.range(0, n, 1, 1).select(
        F.udf(street)("id").alias("rua"), F.lit("Bairro 1").alias("bairro"), F.lit("Cidade").alias("cidade"), F.lit("PR").alias("estado"),
        F.lit(80.0).alias("area_m2"), *[F.lit(1).alias(c) for c in ("quartos", "banheiros", "vagas_garagem")],
    )
    priced, aside = price_new_listings(new, cache, poi, model, "m", "1.0.0")
    assert priced.count() == spark.range(n).where("id % 12 % 4 > 0").count()
    assert aside.count() == n - priced.count()
    assert read.value == n
